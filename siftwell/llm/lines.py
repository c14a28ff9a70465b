"""Line deduplication by content-defined chunks of lines.

A hash rolled over the hashes of two neighbouring lines decides whether a chunk ends there, so an insertion
moves only the boundaries beside it. Chunks of several lines that are found again anywhere in the corpus,
byte for byte, are removed except where they come first (by doc_id, then place). As boundaries near the ends
of a passage depend on what is around it, a repeat then takes in the lines beside it that are also beside its
first occurrence (up to ``BESIDE`` on either side, by their hashes). A chunk of one line goes only as part of such a run, of ``RUN`` lines or more. A line of
``PASSAGE`` words or more is a passage by itself: it is a chunk of its own and may go like chunks of several
lines. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import digest_of, join_per_key, materialize, read_table, text_or_empty

#: One in so many lines ends a chunk.
DIVISOR = 2
#: Lines of a repeated run that takes a chunk of one line with it.
RUN = 3
#: Lines on either side of a chunk that a repeat may take in.
BESIDE = 6
#: Words (by spaces) from which a single line counts as a passage of its own; None: no line does.
PASSAGE: int | None = 50

_LAST = 2**63 - 1


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row: lambdas over plain columns would repeat it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks_of(text: Column, passage: int | None = PASSAGE) -> Column:
    """``array<struct<pos, body, whole, filled, prev, next>>``.

    ``pos``: the first line's number; ``body``: the lines; ``whole``: several lines or a passage; ``filled``: not only
    white space; ``prev`` and ``next``: hashes of the lines beside.
    """

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
        long = F.transform(lines, lambda x: _words(x) >= passage if passage else F.lit(False))
        known = F.struct(hashes.alias("h"), long.alias("long"), F.transform(lines, lambda x: F.xxhash64(x)).alias("x"))
        return _let(known, lambda of: _let(starts(lines, of), lambda at: F.transform(at, lambda s, k: chunk(lines, of, at, s, k))))

    def starts(lines: Column, of: Column) -> Column:
        rolled = lambda i: (F.get(of["h"], i - 2) * 31 + F.get(of["h"], i - 1)) % DIVISOR == 0  # noqa: E731  over the two lines before i
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.get(of["long"], i) | F.get(of["long"], i - 1) | F.coalesce(rolled(i), F.lit(False)))

    def chunk(lines: Column, of: Column, at: Column, s: Column, k: Column) -> Column:
        n = F.coalesce(F.get(at, k + 1), F.size(lines)) - s
        own, near = F.slice(lines, s + 1, n), F.least(s, F.lit(BESIDE))
        return F.struct(
            s.alias("pos"), own.alias("body"), ((n > 1) | F.get(of["long"], s)).alias("whole"), F.exists(own, lambda x: F.trim(x) != "").alias("filled"),
            F.slice(of["x"], s - near + 1, near).alias("prev"), F.slice(of["x"], s + n + 1, F.lit(BESIDE)).alias("next"),
        )

    return _let(F.split(text, "\n", -1), cut)


def _common(a: Column, b: Column) -> Column:
    """How many elements from the start on are the same."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def repeats(rows: DataFrame, passage: int | None = PASSAGE) -> DataFrame:
    """``doc, key, pos, n, gone, before, after`` of chunks that are there more than once, from rows ``doc, key, text``.

    ``pos`` and ``n``: the chunk's lines; ``gone``: it came before and goes; ``before`` and ``after``: lines beside it that
    came before, too. Chunks of one line that stay are left out.
    """
    cut = rows.select("doc", "key", F.explode(chunks_of(F.col("text"), passage)).alias("c")).where("c.filled")
    each = cut.select("doc", "key", "c.pos", "c.whole", "c.body", "c.prev", "c.next", F.xxhash64("c.body").alias("h"))
    # Thin rows first: hashes that are there once need no look at their bytes.
    twice = materialize(each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "line-hashes")
    suspects = join_per_key(each, twice, "h", how="inner", spread=["doc", "key", "pos"]).drop("h")
    suspects = materialize(suspects.withColumn("digest", F.sha2(F.concat(F.col("whole").cast("string"), F.array_join("body", "\n")), 256)), "line-suspects")
    place = F.struct("doc", "key", "pos")
    # Grouping on the lines compares their bytes; map tasks fold their own copies first.
    firsts = suspects.groupBy("body", "whole").agg(F.min(F.struct(place.alias("at"), "prev", "next")).alias("first"), F.first("digest").alias("digest"), F.count("*").alias("size"))
    firsts = materialize(firsts.where("size > 1").select("digest", "first", "size"), "line-firsts")
    thin = suspects.withColumn("n", F.size("body")).drop("body")
    again = join_per_key(thin, firsts, "digest", how="inner", spread=["doc", "key", "pos"])
    before, after = _common(F.reverse("prev"), F.reverse("first.prev")), _common(F.col("next"), F.col("first.next"))
    found = again.select("doc", "key", "pos", "n", "whole", (place != F.col("first.at")).alias("again"), before.alias("before"), after.alias("after"))
    gone = F.col("again") & (F.col("whole") | (F.col("before") + F.col("after") >= RUN - 1))
    return found.withColumn("gone", gone).where("gone OR whole").drop("whole", "again")


def _left(lines: Column, marks: Column) -> Column:
    """The lines that stay: all but those of chunks that go and those beside them; whole chunks whose like went elsewhere are not trimmed."""
    none = F.array().cast("array<int>")
    span = lambda a, n: F.when(n > 0, F.sequence(a, a + F.greatest(n, F.lit(1)) - 1)).otherwise(none)
    every = lambda which, spans: F.flatten(F.transform(F.filter(marks, which), spans))
    goes, stays = (lambda m: m["gone"]), (lambda m: ~m["gone"])
    own = every(goes, lambda m: span(m["pos"], m["n"]))
    beside = every(goes, lambda m: F.concat(span(m["pos"] - m["before"], m["before"]), span(m["pos"] + m["n"], m["after"])))
    removed = F.array_sort(F.array_union(own, F.array_except(beside, every(stays, lambda m: span(m["pos"], m["n"])))))

    def gaps(out: Column) -> Column:
        def gap(j: Column) -> Column:
            start = F.coalesce(F.get(out, j - 1) + 1, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(out, j), F.size(lines)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(out)), gap))

    return _let(removed, gaps)


def deduplicate(docs: DataFrame, passage: int | None = PASSAGE) -> DataFrame:
    """All rows and columns of ``docs``, with repeated chunks taken out of ``text``, and ``n_lines``, ``n_removed``.

    Null texts come out empty. Rows that agree in doc_id and text share their decisions: the first copy's
    chunks stay in each of them. A null doc_id comes after all others. A row all of whose lines are
    removed has an empty text. No rows in, no rows out. Columns of the input named ``n_lines`` or ``n_removed``
    are replaced; all others are kept, whatever their names.
    """
    base = docs.drop("n_lines", "n_removed")
    ends = "_" * max(map(len, base.columns))
    doc, key, marks, kept = (f"{k}{ends}" for k in ("_doc", "_key", "_marks", "_kept"))
    named = base.withColumn("text", text_or_empty()).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(key, digest_of(F.col("text")))
    found = repeats(named.select(F.col(doc).alias("doc"), F.col(key).alias("key"), "text"), passage).dropDuplicates(["doc", "key", "pos"])
    by_row = found.groupBy(F.col("doc").alias(doc), F.col("key").alias(key)).agg(F.collect_list(F.struct("pos", "n", "gone", "before", "after")).alias(marks))
    cut = named.join(by_row, [doc, key], "left").withColumn(kept, F.when(F.exists(marks, lambda m: m["gone"]), _left(F.split("text", "\n", -1), F.col(marks))))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = cut.withColumn("n_lines", lines).withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size(kept), F.lit(0)).cast("long"))
    left = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", left).select(*base.columns, "n_lines", "n_removed")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _same_lines(a: str, b: str) -> str:
    return f"coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false), 0) - 1, least(len({a}), len({b})), 0)"


OP5_SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs,
             list_transform(ls, lambda x: length(x) - length(replace(x, ' ', '')) + 1 >= {PASSAGE}) AS lg FROM l),
s AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = 1 OR lg[i] OR lg[i - 1] OR (i > 2 AND (hs[i - 2] * 31 + hs[i - 1]) % {DIVISOR} = 0)) AS st FROM h),
c AS (SELECT doc_id, ls, lg, st, unnest(range(1, len(st) + 1)) AS k FROM s),
e AS (SELECT doc_id, st[k] AS pos, lg[st[k]] AS long_line, ls[st[k] : coalesce(st[k + 1], len(ls) + 1) - 1] AS body,
             list_reverse(ls[greatest(st[k] - {BESIDE}, 1) : st[k] - 1]) AS prev,
             ls[coalesce(st[k + 1], len(ls) + 1) : coalesce(st[k + 1], len(ls) + 1) + {BESIDE} - 1] AS next FROM c),
w AS (SELECT *, len(body) AS n, len(body) > 1 OR long_line AS whole FROM e WHERE trim(array_to_string(body, ' ')) <> ''),
r AS (SELECT *, count(*) OVER p AS times, first_value(doc_id) OVER f AS first_doc, first_value(pos) OVER f AS first_pos FROM w
      WINDOW p AS (PARTITION BY body, whole), f AS (PARTITION BY body, whole ORDER BY doc_id, pos)),
m AS (SELECT r.*, {_same_lines("r.prev", "f.prev")} AS before, {_same_lines("r.next", "f.next")} AS after
      FROM r JOIN r f ON f.doc_id = r.first_doc AND f.pos = r.first_pos WHERE r.times > 1),
g AS (SELECT * FROM m WHERE (doc_id <> first_doc OR pos <> first_pos) AND (whole OR before + after >= {RUN} - 1)),
q AS (SELECT m.doc_id, unnest(range(m.pos, m.pos + m.n)) AS i FROM m ANTI JOIN g USING (doc_id, pos) WHERE m.whole),
b AS (SELECT doc_id, unnest(list_concat(range(pos - before, pos), range(pos + n, pos + n + after))) AS i FROM g),
x AS (SELECT doc_id, unnest(range(pos, pos + n)) AS i FROM g UNION (SELECT * FROM b EXCEPT SELECT * FROM q)),
y AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l)
SELECT y.doc_id, coalesce(string_agg(line, chr(10) ORDER BY y.i) FILTER (x.i IS NULL), '') AS text, count(*) AS n_lines, count(x.i) AS n_removed
FROM y LEFT JOIN x ON x.doc_id = y.doc_id AND x.i = y.i GROUP BY y.doc_id
"""
