"""Removal of repeated runs of lines by a suffix array over line ids.

The lines of all documents form sequences of line ids. Prefix doubling gives every suffix the rank of its first line,
then of its first two, and so on, by sorting pairs of ranks; suffixes of one rank are an interval of the suffix array
whose common prefix is at least that long. Only suffixes that share an interval go on to the next step, and doubling
ends at the depth of ``min_lines``: sorting deeper could not change which lines lie in a repeated run. In each interval
all suffixes but the first in document order start a later copy; overlapping ones together are the maximal runs.
A shorter run counts too if its lines have ``min_words`` words; its interval is that of a lower depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed
from lapak.llm.batches import written
from lapak.llm.registry import query, table
from lapak.operators.ordering import assign_rank

MIN_LINES = 3
# Words of a run of fewer lines that counts by its size. Shorter ones stay, however often they come.
MIN_WORDS = 50
# Before each line with a word: blank lines belong to the line above them.
BREAK = r"\n(?=[^\n]*[^\x20\x09-\x0D])"
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _own (hash of the text) and the whole row as _doc, so that its other names cannot clash."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.struct(*docs.columns).alias("_doc"))
    return rows.withColumn("_own", F.xxhash64("_text"))


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), at (place of the line), words, and two 64-bit hashes of each line with a word."""
    units = F.posexplode(F.split("_text", BREAK)).alias("at", "_unit")
    lines = _texts(docs.select("doc_id", "text")).select("doc_id", F.col("_own").alias("own"), units)
    line = F.substring_index("_unit", "\n", 1)
    return lines.filter(F.length(F.btrim(line, F.lit(BLANK))) > 0).select(
        "doc_id", "own", "at", F.regexp_count(line, F.lit(WORD)).alias("words"), F.xxhash64(line).alias("x"),
        F.xxhash64(F.lit(1), line).alias("y"))


def _ranked(suffixes: DataFrame, first: bool = False) -> DataFrame:
    """Suffixes that share (x, y) with a suffix elsewhere, with their rank in the order of (x, y) and the first place."""
    place = F.struct("doc_id", "own", "at")
    groups = suffixes.groupBy("x", "y")
    if first:
        # Counts combine in hash tables; rows given twice are sorted out by distinct() below.
        shared = groups.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("x", "y")
    else:
        shared = groups.agg(F.min(place).alias("first"), F.max(place).alias("_last")).filter(
            F.col("first") < F.col("_last")).drop("_last")
    ranks = assign_rank(shared, [F.col("x"), F.col("y")])
    found = suffixes.join(ranks, ["x", "y"]).drop("x", "y")
    return found.distinct() if first else found


def _later(level: DataFrame, lines: int) -> DataFrame:
    """Starts of runs of ``lines`` lines that also start earlier; the first place of each rank is added where missing."""
    place = F.struct("doc_id", "own", "at")
    if "first" not in level.columns:
        level = level.join(level.groupBy("rank").agg(F.min(place).alias("first")), "rank")
    return level.filter(place > F.col("first")).select("doc_id", "own", "at", F.lit(lines).alias("lines"))


def repeated_starts(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, own, at of every line at which ``lines`` lines start that also start earlier: ``min_lines`` of them, or
    fewer with at least ``min_words`` words (None: never fewer). A place may come with several lengths.

    Earlier means a smaller doc_id (nulls first), then a smaller hash of the text, then a place further up.
    """
    ids = line_ids(docs)
    if min_words is None:
        ids = ids.drop("words")
    else:
        ids = ids.withColumn("line_words", F.col("words"))
    level, depth, sized = written(_ranked(ids, first=True), "lines"), 1, []
    counts = [] if min_words is None else ["words", "line_words"]
    while depth < min_lines:
        # Runs that count by their words need the ranks of every depth, others only those of the doubling.
        step = min(depth, min_lines - depth) if min_words is None else 1
        if min_words is not None:
            sized.append(_later(level.filter(F.col("words") >= min_words), depth))
        ahead = level.select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), (F.col("at") - step).alias("_at"),
                             F.col("rank").alias("y"), *[F.col(c).alias(f"_{c}") for c in counts])
        same = (F.col("own") == F.col("_own")) & (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
        total = [(F.col("line_words") + F.col("_words")).alias("words"), "line_words"] if counts else []
        pairs = level.join(ahead, same).select("doc_id", "own", "at", F.col("rank").alias("x"), "y", *total)
        level, depth = written(_ranked(pairs), "lines"), depth + step
    starts = _later(level, depth)
    for more in sized:
        starts = starts.unionByName(more)
    return starts


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """The documents as structs _doc, with _left, their text without later copies of repeated runs, and _n_lines,
    _n_removed, _n_runs and _longest_run. Lines are parted by line feeds; blank ones go and stay with the line above.

    A null text stays null. Rows equal in id and text count as one document and get the same result. A document may be
    left with an empty text. An empty table gives no rows.
    """
    starts = repeated_starts(docs, min_lines, min_words).groupBy("doc_id", "own", "at").agg(F.max("lines").alias("lines"))
    starts = starts.groupBy("doc_id", "own").agg(F.collect_list(F.struct("at", "lines")).alias("_runs"))
    # Each line of a run once.
    covered = F.flatten(F.transform("_runs", lambda r: F.sequence(r["at"], r["at"] + r["lines"] - 1)))
    starts = starts.select(F.col("doc_id").alias("_id"), F.col("own").alias("_hash"),
                           F.sort_array(F.array_distinct(covered)).alias("_at"))
    rows = _texts(docs).join(starts.hint("shuffle_hash"), (F.col("_own") == F.col("_hash")) & F.col("doc_id").eqNullSafe(
        F.col("_id")), "left")
    gap = lambda s, i, step: F.abs(F.get("_at", i + step) - s)
    far = lambda distance: F.coalesce(distance > 1, F.lit(True))
    word = F.length(F.btrim(F.substring_index(F.element_at("_units", 1), "\n", 1), F.lit(BLANK))) > 0
    rows = computed(rows, _units=F.split("_text", BREAK),
                    _open=F.filter("_at", lambda s, i: (i == 0) | far(gap(s, i, -1))),
                    _close=F.transform(F.filter("_at", lambda s, i: far(gap(s, i, 1))), lambda s: s + 1))
    last = F.size("_open")

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("_close", i - 1))
        end = F.when(i < last, F.get("_open", i)).otherwise(F.size("_units"))
        return F.slice("_units", begin + 1, end - begin)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), piece)), "\n")
    sizes = F.zip_with("_close", "_open", lambda e, s: e - s)
    rows = computed(
        rows, _left=F.when(F.col("_at").isNull(), F.col("_doc.text")).otherwise(kept),
        _n_lines=(F.size("_units") - F.when(word, 0).otherwise(1)).cast("long"),
        _n_removed=F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        _n_runs=F.when(F.col("_at").isNull(), 0).otherwise(last).cast("long"),
        _longest_run=F.coalesce(F.array_max(sizes), F.lit(0)).cast("long"))
    return rows.select("_doc", "_left", "_n_lines", "_n_removed", "_n_runs", "_longest_run")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """The documents with shortened texts and their own columns only; n_chars follows the text."""
    new = {"text": F.col("_left"), "n_chars": F.length("_left").cast("long")}
    found = without_repeats(docs, min_lines, min_words)
    return found.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM raw
), marked AS (
  SELECT *, regexp_matches(line, '[^ \t\n\x0B\x0C\r]') AS word FROM line
), unit AS (
  SELECT *, sum(word::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked
), win AS (
  SELECT doc_id, k, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM unit WHERE word
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), long AS (
  SELECT doc_id, k, a, b, c, len(regexp_extract_all(a, '[^ \t\n\x0B\x0C\r]+')) AS n,
    len(regexp_extract_all(b, '[^ \t\n\x0B\x0C\r]+')) AS m FROM win
), later AS (
  SELECT doc_id, k, 1 AS lines FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_id, k) AS r FROM long
    WHERE n >= 50) WHERE r > 1
  UNION ALL SELECT doc_id, k, 2 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, k) AS r FROM long
    WHERE b IS NOT NULL AND n + m >= 50) WHERE r > 1
  UNION ALL SELECT doc_id, k, 3 FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS r FROM long
    WHERE c IS NOT NULL) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) AS t(d) WHERE d < lines
), runs AS (
  SELECT doc_id, count(*) AS n_removed, sum((prev IS NULL OR prev < k - 1)::INT) AS n_runs
  FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM gone) GROUP BY doc_id
), left_over AS (
  SELECT u.doc_id, sum(word::INT) AS n_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL), '') AS kept
  FROM unit u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.k = u.k GROUP BY u.doc_id
)
SELECT l.doc_id, n_lines::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(kept) AS kept_sha256
FROM left_over l LEFT JOIN runs r ON r.doc_id = l.doc_id
"""


def _figures(found: DataFrame) -> DataFrame:
    return found.select("_doc.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                        F.col("_n_runs").alias("n_runs"), F.sha2(F.coalesce("_left", F.lit("")), 256).alias("kept_sha256"))


@query("op7_line_dedup_sized", SQL)  # the earlier name of the same query
@query("op7_line_dedup", SQL)
def _(spark, sf_dir):
    return _figures(without_repeats(table(spark, sf_dir, "documents")))
