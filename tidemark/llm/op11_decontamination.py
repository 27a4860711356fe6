"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer
words is one window); a document is contaminated where a window occurs in its
words. Windows are sets of positioned shingles (``SHINGLE`` consecutive words;
all words, if the window has fewer).

1. Rarity: one scan counts, over all documents, the occurrences of the shingles
   that the benchmark has (map-side sums; only those shingles are counted).
2. Prefix: a window occurs only if all its shingles do, so the necessary prefix
   is its rarest shingle alone; a window with a shingle that never occurs needs
   no search. The prefix shingles, with the window's text, its length and the
   shingle's offset, are the index.
3. Join: a second scan looks the shingle of every document position up in the
   index; the offset gives the only start the window can have (positional
   bound), which must leave room for its length (length bound).
4. Verification: the words at that start must be the window's, exactly.

Only occurrences leave the scans: one row per (document, start), then sums per
document. The benchmark side is broadcast in parts of at most ``PART_ROWS``
rows, counted before; a larger benchmark takes one scan per part, so nothing
grows with it but the number of scans. Documents are told apart by id and a
128-bit digest of their text; repeated rows are worked on once.

Words are the runs of code points other than U+0000-2F, 3A-60 and 7B-7F after
A-Z became a-z. The shingle keys use ``lower`` (all letters), which equals more,
never less; the verification changes A-Z only.

Defined cases: a null, empty or wordless text has no words and no hits; a
wordless or null item has no window; a null item_id has windows that hit but is
not counted or listed; rows with one item_id are one item; a null doc_id is a
document like others; an empty table gives no rows (documents) or no hits
(benchmark); other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted, cut, stored

WINDOW, SHINGLE = 10, 3
#: Index rows that one scan of the documents holds in memory.
PART_ROWS = 500_000
#: Separators of words before A-Z became a-z.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a text column, letters as they are; none for null."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _GAP, -1), "")


def _key(words: str, at: str, length: int) -> str:
    """Hash of the shingle of ``length`` words at position ``at`` (from 0)."""
    return "xxhash64(" + ", ".join(f"lower(get({words}, {at} + {j}))" for j in range(length)) + ")"


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, w, len): the distinct windows of every item, A-Z as a-z."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    cut_up = (items.select("item", words_of("text").alias("words")).where("size(words) > 0")
              .selectExpr("item", "words", f"least(size(words), {WINDOW}) as len")
              .selectExpr("item", "words", "len", "explode(sequence(0, size(words) - len)) as at"))
    return (cut_up.selectExpr("item", f"translate(array_join(slice(words, at + 1, len), ' '), '{_UPPER}', '{_LOWER}') as w",
                              "len").distinct())


def window_shingles(windows: DataFrame) -> DataFrame:
    """(w, len, off, size, key): every shingle of every distinct window."""
    each = (windows.select("w", "len").distinct()
            .selectExpr("w", "len", "split(w, ' ') as words", f"least(len, {SHINGLE}) as size")
            .selectExpr("*", "explode(sequence(0, len - size)) as off"))
    key = " ".join(f"when {k} then {_key('words', 'off', k)}" for k in range(1, SHINGLE + 1))
    return each.selectExpr("w", "len", "off", "size", f"case size {key} end as key")


def document_words(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t1, t2, words) of every row: the digest of its text is t1, t2."""
    own = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.reverse("text")).alias("t2"),
                      words_of("text").alias("words"))


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """One row per position with a whole shingle of ``size`` words. (The outer
    form, since the planner adds a filter on the words below the other, and the
    texts would be split twice; a null position passes no filter.)"""
    return (docs.selectExpr("doc_id", "t1", "t2", "words", "posexplode_outer(words) as (pos, word)")
            .selectExpr("doc_id", "t1", "t2", "words", "pos", f"{_key('words', 'pos', size)} as key")
            .where(f"pos <= size(words) - {size}"))


def _parts(table: DataFrame, rows: int) -> list[DataFrame]:
    """The table in pieces of about PART_ROWS rows at most."""
    n = -(-2 * rows // PART_ROWS) if rows > PART_ROWS else 1
    return [table.where(f"pmod(xxhash64(key), {n}) = {i}") if n > 1 else table for i in range(n)]


def shingle_counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, n): occurrences, over all documents, of the shingles that occur."""
    keys = stored(shingles.select("size", "key").distinct())
    found = []
    for size, rows in sorted((r.size, r.n) for r in keys.groupBy("size").agg(F.count("*").alias("n")).collect()):
        for part in _parts(keys.where(f"size = {size}").select("key"), rows):
            found.append(_positions(docs, size).select("key").join(F.broadcast(part), "key")
                         .groupBy("key").agg(F.count("*").alias("n")).selectExpr("key", f"{size} as size", "n"))
    return reduce(DataFrame.unionByName, found) if found else keys.selectExpr("key", "size", "0L as n")


def prefix_index(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, size, off, len, w) of windows all of whose shingles occur: the
    rarest shingle of each."""
    ranked = (shingles.join(counts, ["key", "size"], "left").groupBy("w", "len", "size")
              .agg(F.min(F.expr("struct(coalesce(n, 0L) as n, key, off)")).alias("rarest")))
    return ranked.where("rarest.n > 0").selectExpr("rarest.key as key", "size", "rarest.off as off", "len", "w")


def occurrences(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, start, len, w): every place where a window occurs."""
    index = stored(index)
    found = []
    for size, rows in sorted((r.size, r.n) for r in index.groupBy("size").agg(F.count("*").alias("n")).collect()):
        for part in _parts(index.where(f"size = {size}").drop("size"), rows):
            found.append(_positions(docs, size).join(F.broadcast(part), "key")
                         .where("pos >= off and pos - off + len <= size(words)")
                         .where(f"translate(array_join(slice(words, pos - off + 1, len), ' '), '{_UPPER}', '{_LOWER}') = w")
                         .selectExpr("doc_id", "t1", "t2", "pos - off as start", "len", "w"))
    if found:
        return reduce(DataFrame.unionByName, found)
    return docs.where("false").selectExpr("doc_id", "t1", "t2", "0 as start", "0 as len", "'' as w")


def contaminated_documents(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) of every row."""
    windows = stored(benchmark_windows(benchmark, item_id, item_text))
    shingles = stored(window_shingles(windows))
    docs = document_words(documents, doc_id, text)
    index = prefix_index(shingles, shingle_counts(docs, shingles))
    places = cut(occurrences(docs, index).groupBy("doc_id", "t1", "t2", "start", "len", "w").agg(F.lit(1).alias("one")))
    key = "doc_id, t1, t2"
    hits = (places.groupBy("doc_id", "t1", "t2", "start").agg(F.max("len").alias("len"))
            .selectExpr("doc_id", "t1", "t2", "start", "start + len as end",
                        f"max(start + len) over (partition by {key} order by start "
                        "rows between unbounded preceding and 1 preceding) as reach")
            .groupBy("doc_id", "t1", "t2")
            .agg(F.expr("sum(greatest(0, end - greatest(start, coalesce(reach, 0))))").alias("n_hit")))
    items = (places.select("doc_id", "t1", "t2", "w").distinct().join(windows.where("item is not null"), "w")
             .select("doc_id", "t1", "t2", "item").distinct()
             .groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_list("item")).alias("items")))
    same = F.expr("doc_id <=> h_id and t1 = h1 and t2 = h2")
    found = cut(hits.selectExpr("doc_id as i_id", "t1 as i1", "t2 as i2", "n_hit")
                .join(items, F.expr("doc_id <=> i_id and t1 = i1 and t2 = i2"), "left")
                .selectExpr("i_id as h_id", "i1 as h1", "i2 as h2", "n_hit", "items"))
    return (docs.selectExpr("doc_id", "t1", "t2", "cast(size(words) as long) as n_words")
            .join(counted(found), same, "left")
            .selectExpr("doc_id", "n_words", "cast(coalesce(n_hit, 0) as long) as n_hit",
                        "coalesce(items, cast(array() as array<string>)) as item_ids"))


def contamination_digest(documents: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contaminated_documents(documents, benchmark, **columns).selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(item_ids) as long) as n_items",
        "sha2(array_join(item_ids, ','), 256) as items_sha256", "n_hit > 0 as contaminated")


def contamination_sql() -> str:
    """The same rows in DuckDB SQL: every word sequence of every document
    against every window."""
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return rf"""
with d as (select row_number() over () as k, doc_id, {words} as words from documents),
i as (select item_id, {words} as words from benchmark),
win as (
  select distinct item_id, least(len(words), {WINDOW}) as n,
    unnest([array_to_string(words[p:p + least(len(words), {WINDOW}) - 1], ' ')
            for p in range(1, len(words) - least(len(words), {WINDOW}) + 2)]) as w
  from i where len(words) > 0),
sizes as (select distinct n from win),
seq as (
  select k, n, unnest(range(1, len(words) - n + 2)) as p, words from d, sizes where len(words) >= n),
occ as (
  select s.k, s.p, s.n, w.item_id
  from (select k, n, p, array_to_string(words[p:p + n - 1], ' ') as w from seq) s join win w on s.w = w.w and s.n = w.n),
hit as (select k, count(distinct q) as n_hit from (select k, unnest(range(p, p + n)) as q from occ) group by k),
it as (
  select k, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from (select distinct k, item_id from occ where item_id is not null) group by k)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (k) left join it using (k)
"""
