"""Benchmark decontamination by a hash set of the benchmark's word windows, in DataFrame functions only.

Words are lower-cased runs of letters, digits and all non-ASCII characters. A
window is 13 consecutive words of a benchmark item; an item of fewer words,
but not none, is one window. Documents are scanned in two steps. Every window
of L words holds a block of (L+1)//2 words whose place in the document is a
multiple of that size, so only these aligned blocks are looked up at first;
documents without a hit are done. The others look up all their windows. The
set holds the words themselves, so a hit is verified by the look-up.

The hash set has a checked size: up to MAX_SET windows and MAX_BYTES of text
it is part of the plan on each executor. Beyond that both steps are shuffled
joins: the aligned blocks of all documents, together about as long as the text
for each window size, and then the windows of the documents that hit.

Defined results: a null text has no words; null item texts have no windows; a
null item_id counts as the item "null"; repeated rows are judged one by one,
whatever their doc_id; an empty benchmark hits nothing; `remove_leaks` keeps
all further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import written

WINDOW = 13
#: Windows up to which the hash set is sent to all executors.
MAX_SET = 100_000
#: Bytes of text in them up to which it is.
MAX_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words, lower-cased and joined by single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def count_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def blocks_of(norm: Column, size: int) -> Column:
    """Words 1..size, size+1..2*size, ... as strings; what is left at the end has none. One linear scan."""
    return F.regexp_extract_all(norm, F.lit(f"(?:[^ ]++ ){{{size - 1}}}[^ ]++"), F.lit(0))


def windows_of(norm: Column, size: int, keep=None) -> Column:
    """All windows of `size` words as (pos, size, win), from the blocks of the text without its first 0..size-1 words."""

    def shifted(s: Column) -> Column:
        rest = F.regexp_replace(norm, F.concat(F.lit("^(?:[^ ]+ ){"), s.cast("string"), F.lit("}")), F.lit(""))
        placed = F.transform(blocks_of(rest, size), lambda w, i: F.struct((s + 1 + i * size).cast("int").alias("pos"), F.lit(size).alias("size"), w.alias("win")))
        return F.filter(placed, lambda t: t["win"].isin(keep)) if keep is not None else placed

    last = (F.least(F.lit(size).cast("long"), count_words(norm)) - 1).cast("int")
    return F.when(norm != "", F.flatten(F.transform(F.sequence(F.lit(0), last), shifted))).otherwise(F.array().cast(SPANS))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, size, items): each distinct window, its words joined by blanks, and the items that have it."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), normalised(F.col("text")).alias("norm")).where("norm <> ''")
    w = w.withColumn("words", F.split("norm", " ")).withColumn("size", F.least(F.size("words"), F.lit(window)))
    wins = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.concat_ws(" ", F.slice("words", i, F.col("size"))))
    return w.select("item", "size", F.explode(wins).alias("win")).groupBy("win", "size").agg(F.collect_set("item").alias("items"))


def _blocks(wins: list[str], block: int) -> list[str]:
    """All runs of `block` words inside the windows; about as many as windows."""
    found = set()
    for w in wins:
        words = w.split(" ")
        found.update(" ".join(words[i : i + block]) for i in range(len(words) - block + 1))
    return sorted(found)


def _any_in(values: Column, keep: list[str]) -> Column:
    return F.exists(values, lambda v: v.isin(keep))


SPANS = "array<struct<pos:int,size:int,win:string>>"


def mark_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> tuple[DataFrame, DataFrame]:
    """(docs with `_n`, the number of words, `_row`, a number of the row, and `_spans`; the windows).

    _spans has (pos, size, win) of each window found, pos 1-based. With a
    small hash set each row is done where it is read; else see `_shuffled`.
    """
    if clash := {"_norm", "_n", "_row", "_spans"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already; rename them first")
    wins = benchmark_windows(benchmark, window)
    n, size_of_all = wins.agg(F.count("*"), F.sum(F.octet_length("win"))).first()
    small = n <= max_set and (size_of_all or 0) <= MAX_BYTES
    norm = F.col("_norm")
    rows = docs.withColumn("_norm", normalised(F.col("text"))).withColumn("_n", count_words(norm)).withColumn("_row", F.monotonically_increasing_id())
    if not small:
        return _shuffled(rows, wins), wins
    some = wins.select("win", "size").collect()  # bounded by what was just checked
    hits = [F.array().cast(SPANS)]
    for size in sorted({r["size"] for r in some}):
        own, block = sorted(r["win"] for r in some if r["size"] == size), (size + 1) // 2
        hits.append(F.when(_any_in(blocks_of(norm, block), _blocks(own, block)), windows_of(norm, size, own)).otherwise(F.array().cast(SPANS)))
    return rows.withColumn("_spans", F.concat(*hits).cast(SPANS)).drop("_norm"), F.broadcast(wins)


def _shuffled(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """rows with `_spans`, by two semi-joins: aligned blocks, then the windows of rows and sizes that hit.

    The numbered rows are written once, so that all branches see the same numbers.
    """
    rows = written(rows, "numbered")
    spans = None
    for size in sorted(r["size"] for r in wins.select("size").distinct().collect()):  # at most `window` rows
        block = (size + 1) // 2
        own = wins.where(F.col("size") == size)
        words = F.split("win", " ")
        known = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(size - block + 1)), lambda i: F.concat_ws(" ", F.slice(words, i, block)))).alias("_b")).distinct()
        found = rows.select("_row", F.explode(blocks_of(F.col("_norm"), block)).alias("_b")).join(known, "_b", "left_semi").select("_row").distinct()
        windows = rows.select("_row", "_norm").join(found, "_row", "left_semi").select("_row", F.explode(windows_of(F.col("_norm"), size)).alias("_s"))
        hit = windows.withColumn("_w", F.col("_s.win")).join(own.select(F.col("win").alias("_w")), "_w", "left_semi").select("_row", "_s")
        spans = hit if spans is None else spans.unionByName(hit)
    if spans is None:
        return rows.drop("_norm").withColumn("_spans", F.array().cast(SPANS))
    spans = spans.groupBy("_row").agg(F.collect_list("_s").alias("_spans"))  # what one text has
    return rows.drop("_norm").join(spans, "_row", "left").withColumn("_spans", F.coalesce(F.col("_spans").cast(SPANS), F.array().cast(SPANS)))


def covered(spans: Column) -> Column:
    """The distinct words, by place, inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1))))


def _hit(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", F.size(covered(F.col("_spans"))).cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_n")))


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """doc_id, n_words, n_hit, items (distinct ids as strings, sorted) and contaminated: a twentieth of the words or more are hit."""
    found, wins = mark_spans(docs.select("doc_id", "text"), benchmark, window, max_set)
    found = _hit(found).select("_row", "doc_id", F.col("_n").alias("n_words"), "n_hit", "contaminated", F.explode_outer("_spans").alias("_s"))
    found = found.withColumn("_w", F.col("_s.win")).join(wins.select(F.col("win").alias("_w"), F.col("items").alias("_i")), "_w", "left")
    found = found.groupBy("_row", "doc_id", "n_words", "n_hit", "contaminated").agg(F.collect_set("_i").alias("_i"))
    return found.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct(F.flatten("_i"))).alias("items"), "contaminated")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs without its contaminated rows; from the others the words of found windows are cut out.

    n_chars, where there is such a column, is counted again for texts that were cut.
    """
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text")  # so no name can clash
    found, _ = mark_spans(inner, benchmark, window, max_set)
    found = _hit(found).where(~F.col("contaminated"))
    bounds = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.array_remove(F.split("text", bounds, -1), "")
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)  # one more than words
    cut = covered(F.col("_spans"))
    left = F.transform(words, lambda w, i: F.when(F.array_contains(cut, i + 1), "").otherwise(w))
    text = F.array_join(F.zip_with(gaps, F.concat(left, F.array(F.lit(""))), lambda g, w: F.concat(g, w)), "")
    found = found.withColumn("text", F.when(F.col("n_hit") > 0, text).otherwise(F.col("text")))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        own = F.col("_doc")[c]
        return F.when(F.col("n_hit") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == "n_chars" else own.alias(c)

    return found.select(*(column(c) for c in docs.columns))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return leak_report(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rk, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT rk, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT rk, item, i, dw.size AS size FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
n AS (SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rk, i, size FROM hit)) GROUP BY rk),
t AS (SELECT rk, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rk, item FROM hit) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rk) LEFT JOIN t USING (rk)
"""
