"""Line deduplication across documents, with DataFrame functions alone.

Every line gets a key: the line without white space at its ends, A-Z lower-cased. A key that two
or more documents hold keeps its lines in the smallest document id alone.

How it runs:

1. Lines long enough to count become (hash of 128 bits, document, position), written once to the shared folder.
2. Keys with more than ``heavy_lines`` lines are found by counting hash slots and then only the keys of heavy slots.
   Their lines never meet in one task: the table of their first documents, at most one key for each ``heavy_lines``
   lines, is broadcast, or beyond ``MAX_BROADCAST`` keys joined with both sides salted.
3. All other hashes are range-partitioned with a secondary sort by document and position; a window streams each
   sorted run and marks what comes after the first document.
4. The marks become a bitmap for each document, in words of 64 lines, of which only words with a dropped line are
   stored. Texts are not moved for any of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, packed, text_or_empty

#: The ASCII white space of the contract, and the letters that are lower-cased.
SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lines of one key that one task may sort, and the share of all lines above which a key is heavy in a small table.
HEAVY_LINES, HEAVY_SHARE = 100_000, 1 / 512
#: Heavy keys (some 50 bytes each) that are broadcast, and tasks that share the lines of one beyond that.
MAX_BROADCAST, SALTS = 500_000, 64
#: Document id under which rows with a null id are compared: they come first.
NULL_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Names a row by its id and text; repeated rows share a name and so a result."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("_doc"), F.xxhash64(text_or_empty(text)).alias("_row")]


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 10, heavy_lines: int = HEAVY_LINES, max_broadcast: int = MAX_BROADCAST, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document row that loses lines: ``_doc``, ``_row``, ``n_dropped`` and ``keep``.

    ``keep`` is an array of (word, bits), sorted by word: bit i of word w says whether line 64 * w + i stays. Words
    that are not stored keep all their lines. ``docs`` has ``doc_id`` and ``text``; other columns are ignored.

    Null and empty texts are one empty line and lose nothing. A null id counts as one document, smaller than all
    others. Rows that share an id count as one document; repeated rows get the same bitmap.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    doc, row = row_key(F.col("doc_id"), F.col("text"))
    line = docs.select(doc, row, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    digest = F.md5(F.col("key").cast("binary"))
    lines = scratch.written(
        line.filter(F.char_length("key") >= min_chars).select(
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), F.substring(digest, 16, 17).alias("h_more"), "_doc", "_row", "pos"
        )
    )
    # Above this a key is heavy; at most total / limit slots and keys are.
    total = lines.count()
    limit = min(heavy_lines, max(1000, int(total * HEAVY_SHARE)))
    slot = F.pmod("h", F.lit(8 * max(512, total // limit)))
    heavy_slots = lines.groupBy(slot.alias("slot")).count().filter(F.col("count") > limit).select("slot")
    heavy = (
        lines.join(F.broadcast(heavy_slots) if total // limit <= max_broadcast else heavy_slots, slot == F.col("slot"), "left_semi")
        .groupBy("h", "h_more")
        .agg(F.count("*").alias("n"), F.min("_doc").alias("first_doc"))
        .filter(F.col("n") > limit)
        .select("h", "h_more", "first_doc")
    )
    heavy = scratch.written(heavy)
    key = ["h", "h_more"]
    if heavy.count() <= max_broadcast:
        small = F.broadcast(heavy)
    else:
        # A heavy key's lines are dealt to several tasks, each with the key's first document.
        key = [*key, "salt"]
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("_doc", "pos"), F.lit(SALTS)))
        small = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
    of_heavy = lines.join(small, key).filter(F.col("_doc") > F.col("first_doc"))
    rest = lines.join(small, key, "left_anti")
    run = Window.partitionBy("h", "h_more").orderBy("_doc", "pos")
    of_rest = (
        rest.repartitionByRange("h", "h_more")
        .sortWithinPartitions("h", "h_more", "_doc", "pos")
        .withColumn("first_doc", F.first("_doc").over(run))
        .filter(F.col("_doc") > F.col("first_doc"))
    )
    columns = ["_doc", "_row", "pos"]
    dropped = of_heavy.select(*columns).unionByName(of_rest.select(*columns))
    words = dropped.groupBy("_doc", "_row", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    )
    return words.groupBy("_doc", "_row").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


#: The stored words as an array with a place for every word up to the last stored one.
_DENSE = """flatten(transform(keep, (x, k) -> concat(
    array_repeat(-1L, x.word - if(k = 0, -1, keep[k - 1].word) - 1), array(x.bits))))"""


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """A row for each of docs: ``d`` (its columns), ``lines`` (all lines), ``kept`` (those that stay), ``n_dropped``."""
    doc, row = row_key(F.col("d.doc_id"), F.col("d.text"))
    marks = bitmaps.select("_doc", "_row", "n_dropped", F.expr(_DENSE).alias("dense"))
    joined = packed(docs).join(marks.hint("shuffle_hash"), (doc == F.col("_doc")) & (row == F.col("_row")), "left")
    stays = "(shiftright(coalesce(get(dense, cast(i div 64 as int)), -1L), cast(i % 64 as int)) & 1L) = 1L"
    return joined.withColumn("lines", lines_of(F.col("d.text"))).select(
        "d",
        "lines",
        F.expr(f"if(dense is null, lines, filter(lines, (x, i) -> {stays}))").alias("kept"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """docs with the lines that stay as ``text``; every other column is as it was. Null texts stay null."""
    bitmaps = line_keep_bitmaps(docs, min_chars, scratch=scratch)
    kept = with_kept_lines(docs, bitmaps)
    text = F.when(F.col("d.text").isNotNull(), F.concat_ws("\n", "kept")).alias("text")
    return kept.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def line_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    kept = with_kept_lines(docs.select("doc_id", "text"), line_keep_bitmaps(docs, min_chars))
    return kept.select(
        F.col("d.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"),
    )


#: DuckDB. The same rule on strings, without hashes or bitmaps.
LINE_DIGEST_SQL = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.*, (f.key IS NOT NULL AND k.doc_id > f.first_doc) AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""
