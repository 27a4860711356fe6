"""Employer reach and composition aggregates."""

from __future__ import annotations

from tidemark.operators import reach

NETWORK = [
    ("Acme Bank", "Senior Data Engineer"), ("Acme Bank", "Head of Data"),
    ("Acme Bank", "Technical Recruiter"), ("Acme Bank", "Marketing Specialist"),
    ("Globex", "Business Intelligence Analyst"), ("Globex", "Analytics Engineer"),
    ("Initech", "Backend Developer"), ("Initech", "Talent Acquisition Partner"),
    ("Umbrella", "Graphic Designer"), (None, "Data Analyst"), ("(unknown)", "Data Analyst"),
    ("  ", "Data Analyst"),
]


def net(spark):
    return spark.createDataFrame(NETWORK, "company_name string, position string")


def test_reach_counts_every_kind_of_door(spark):
    r = {x["company"]: x for x in reach.company_reach(net(spark)).collect()}
    acme = r["Acme Bank"]
    assert (acme["core_peers"], acme["data_leaders"], acme["recruiters"], acme["connections"]) == \
        (1, 1, 1, 4)
    assert acme["reach"] == 9 and acme["has_front_door"] is True
    assert r["Globex"]["has_front_door"] is False and r["Globex"]["core_peers"] == 2
    assert set(r) == {"Acme Bank", "Globex", "Initech", "Umbrella"}


def test_reach_is_ordered_and_summarised(spark):
    rows = reach.company_reach(net(spark)).collect()
    assert [x["company"] for x in rows][0] == "Acme Bank"
    s = reach.summarise(reach.company_reach(net(spark))).first()
    assert s["companies"] == 4 and s["with_core"] == 2 and s["front_door"] == 2
    assert s["all_three"] == 1


def test_tag_counts_sum_with_untagged(spark):
    df = spark.createDataFrame([(p,) for _, p in NETWORK], "position string")
    counts = {x["tag"]: x["connections"] for x in reach.tag_counts(df).collect()}
    assert counts["recruiter_talent"] == 2 and counts["untagged"] == 2
    assert len(counts) == 7


def test_leaders_outside_the_field_cannot_hire(spark):
    df = spark.createDataFrame([("Contoso", "Sales Director")], "company_name string, position string")
    r = reach.company_reach(df).first()
    assert (r["data_leaders"], r["core_peers"], r["reach"]) == (0, 0, 0)


def test_target_families_change_the_ranking(spark):
    from tidemark.functions.taxonomy import ADJACENT_FAMILIES
    as_data = {x["company"]: x for x in reach.company_reach(net(spark)).collect()}
    as_eng = {x["company"]: x for x in reach.company_reach(
        net(spark), target=("Software Engineering",), adjacent=ADJACENT_FAMILIES).collect()}
    assert as_data["Initech"]["core_peers"] == 0 and as_eng["Initech"]["core_peers"] == 1
    assert as_eng["Initech"]["reach"] > as_data["Initech"]["reach"]


def test_closed_company_with_a_leader_is_flagged(spark):
    df = spark.createDataFrame([("Stark", "Head of Analytics")], "company_name string, position string")
    s = reach.summarise(reach.company_reach(df)).first()
    assert (s["front_door"], s["closed_with_leader"]) == (0, 1)


def test_empty_network(spark):
    df = spark.createDataFrame([], "company_name string, position string")
    r = reach.company_reach(df)
    assert r.count() == 0 and r.columns[:2] == ["company", "reach"]
    assert reach.summarise(r).first()["companies"] == 0
