"""Shared fixtures: one local Spark session and two synthetic exports.

The exports follow the export format (note lines, blank line, header, rows
with a quoted comma, an encoded URL, diacritics and one restricted row).
v2 has a different number of note lines, one company change (Ann), one title
change (Cole), one departure (Finn) and two joiners (Jay, Kai).
"""

from __future__ import annotations

import hashlib
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import checkpoint_dir, get_spark  # noqa: E402

HEADER = "First Name,Last Name,URL,Email Address,Company,Position,Connected On"
URL = "https://www.linkedin.com/in/"
V1_ROWS = [
    f"Ann,Example,{URL}ann-example-0001,,Northwind Bank (NWB),Data Analyst,04 Feb 2025",
    f"Ben,Example,{URL}ben-example-0002,,Contoso Group,Technical Recruiter,11 Mar 2025",
    f'"Cole, MSc",Example,{URL}cole-example-0003,,Northwind Software,'
    f'"Senior Analytics Engineer, Tech Lead",18 Apr 2025',
    f"Dara,Example,{URL}dara-example-0004,,Công ty Ví Dụ,Business Intelligence Analyst,02 May 2025",
    f"Eli,Example,{URL}eli-example-0005,eli@example.org,Fabrikam,Director Business Intelligence,"
    f"19 Jun 2025",
    f"Finn,Example,{URL}finn-example-0006,,Northwind Shop,Junior Graphic Designer,23 Jul 2025",
    f"Gia,Example,{URL}gia-example-0007,,Northwind Pay,Senior Engineering Manager,08 Aug 2025",
    f"Hal,Example,{URL}hal-example-0008,,,,15 Sep 2025",
    f"Ivy,Example,{URL}ivy-example-0009,,Northwind Talent,Associate Recruitment Consultant,"
    f"27 Oct 2025",
    f"Đức,Nguyễn,{URL}%C4%91%E1%BB%A9c-nguy%E1%BB%85n-0010,,Northwind Labs,"
    f"Talent Acquisition Partner,03 Nov 2025",
    ",,,,,,12 Nov 2025",
]
V2_ROWS = [
    V1_ROWS[0].replace("Northwind Bank (NWB)", "Contoso Group"),
    V1_ROWS[1],
    V1_ROWS[2].replace('"Senior Analytics Engineer, Tech Lead"', "Principal Data Engineer"),
    V1_ROWS[3], V1_ROWS[4], V1_ROWS[6], V1_ROWS[7], V1_ROWS[8], V1_ROWS[9],
    f"Jay,Example,{URL}jay-example-0011,jay@example.org,Contoso Group,Data Scientist,14 Jan 2026",
    f"Kai,Example,{URL}kai-example-0012,,Northwind Bank (NWB),Chief Technology Officer,"
    f"02 Feb 2026",
    V1_ROWS[10],
]
NOTES_V1 = ["Notes:", '"Some email addresses are blank: only opted-in contacts export one."', ""]
NOTES_V2 = NOTES_V1[:2] + ['"This file carries one more note line than v1."', ""]
TS_V1, TS_V2 = "2026-02-01 09:00:00", "2026-02-08 09:00:00"
KEY_TS_V1, KEY_TS_V2 = "20260201T090000Z", "20260208T090000Z"
PREFIX = "raw/connections"


def export_bytes(notes, rows, header=HEADER) -> bytes:
    return ("\n".join([*notes, header, *rows]) + "\n").encode("utf-8")


EXPORT_V1 = export_bytes(NOTES_V1, V1_ROWS)
EXPORT_V2 = export_bytes(NOTES_V2, V2_ROWS)
EXPORT_MISSING = export_bytes(
    NOTES_V1, [",".join(r.split(",")[:5]) + ",04 Feb 2025" for r in V1_ROWS[:1]],
    header="First Name,Last Name,URL,Email Address,Company,Connected On")


def md5(raw: bytes) -> str:
    return hashlib.md5(raw).hexdigest()


def put(landing: str, key_ts: str, raw: bytes, *, hash8: str | None = None) -> str:
    key = f"{PREFIX}/{key_ts}_{hash8 or md5(raw)[:8]}.csv"
    path = os.path.join(landing, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(raw)
    return key


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[2]", shuffle_partitions=4, app_name="tidemark-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture
def workdir():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def collect_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
