"""How far the sources of a language differ in their words, counted in shards by DuckDB.

Spark deals the work: tasks count the terms of their texts, the counts go to
shards by language and term, and what the shards find is summed and ranked.
Within a task and a shard DuckDB does the counting, one vectorized statement at
a time.  A shard is read in the order of its terms and worked on in chunks of
whole terms, so that its memory doesn't grow with its size.

A source gives a term of its language the share 1 + floor(scale * (n + smooth) /
(N + smooth * V)), with n its occurrences there, N all of the source's, and V the terms
of the language.  Two sources differ by the sum of |p - q| over all V terms.
Terms that neither has add the same to this each; so does what one has and the
other hasn't, but for its share.  So the sum over all terms is V * |z - z'| for
the shares z, z' of terms that aren't there, plus corrections: one for each term of a
source against each z' above its own z, which depends on the count alone, and one
for each term that both have, which the shards sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm.texts import stored

TEXT_BYTES = 8 << 20  # of texts in a statement
PENDING = 400_000  # counts that a task holds, and rows of a chunk
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Audit:
    """least_docs: a language keeps the terms of so many of its documents.  top: terms reported of each source."""

    least_docs: int = 30
    smooth: int = 5
    scale: int = 1_000_000_000
    top: int = 50


COUNTS = "lang string, source string, term string, n long, docs long"

COUNT_TEXTS = f"""
WITH words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{LETTERS}')) AS term FROM texts),
each AS (SELECT row_no, lang, source, term, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM each GROUP BY ALL
"""

MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"

#: Kept terms of a chunk; the smallest source of each is its lead.
KEEP = """
WITH each AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM chunk GROUP BY ALL),
whole AS (SELECT *, sum(docs) OVER w AS all_docs, sum(n) OVER w AS all_n, min(source) OVER w AS first FROM each WINDOW w AS (PARTITION BY lang, term))
SELECT lang, source, term, n, all_n::BIGINT AS lang_n, source = first AS lead FROM whole WHERE all_docs >= {least}
"""

#: What the terms of a chunk add to each pair of sources that have them both.
PAIRS = """
SELECT lang, a.source AS source, b.source AS other, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z))::BIGINT AS both
FROM chunk a JOIN chunk b USING (lang, term) WHERE a.source < b.source GROUP BY ALL
"""

#: The terms of a chunk by which each source stands out most.
TOPS = """
SELECT lang, source, term AS item, p - q AS value FROM chunk WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""


def ask(statement: str, **tables: pa.Table) -> pa.Table:
    """Runs a statement over Arrow tables in this task, on one thread."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
        for name, rows in tables.items():
            db.register(name, rows)
        return db.execute(statement).to_arrow_table()


def batches_of(rows: pa.Table, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    yield from rows.select([f.name for f in schema]).cast(to_arrow_schema(schema)).to_batches(1 << 14)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as each task has them, of docs with lang, source, text."""
    schema = T._parse_datatype_string(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []
        held = 0
        for batch in batches:
            at, sizes = 0, pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= TEXT_BYTES:
                    size += sizes[end]
                    end += 1
                part = pa.table(batch.slice(at, end - at)).append_column("row_no", pa.array(range(at, end), pa.int64()))
                pending.append(ask(COUNT_TEXTS, texts=part))
                held += pending[-1].num_rows
                at = end
                if held > PENDING:
                    merged = ask(MERGE, counts=pa.concat_tables(pending))
                    pending, held = [merged], merged.num_rows
                    if held > PENDING // 2:
                        yield from batches_of(merged, schema)
                        pending, held = [], 0
        if pending:
            yield from batches_of(ask(MERGE, counts=pa.concat_tables(pending)), schema)

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def by_shard(rows: DataFrame, statement: str, schema: str, pending: int = PENDING) -> DataFrame:
    """Runs a statement over `chunk`: whole terms of a shard, as many as make `pending` rows, or one term."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if count + batch.num_rows > pending and held:
                lang, term = batch.column("lang"), batch.column("term")
                last = held[-1]
                before = last.column("lang")[-1].as_py(), last.column("term")[-1].as_py()
                same = pc.and_(pc.equal(lang, before[0]), pc.equal(term, before[1])).to_numpy(zero_copy_only=False)
                cut = len(same) if same.all() else int(same.argmin())
                held.append(batch.slice(0, cut))
                if cut < len(same):
                    yield from batches_of(ask(statement, chunk=pa.Table.from_batches(held)), kind)
                    held, batch = [], batch.slice(cut)
                    count = 0
                else:
                    count += cut
                    continue
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from batches_of(ask(statement, chunk=pa.Table.from_batches(held)), kind)

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, kind)


def share(n: Column, total: Column, rule: Audit) -> Column:
    """1 + floor(scale * n / total) without overflow; 0 where the language has no terms."""
    whole = F.lit(rule.scale).cast("decimal(10,0)") * n.cast("decimal(20,0)")
    return F.when(total > 0, F.expr("1L") + F.call_function("div", whole, total.cast("decimal(20,0)"))).otherwise(F.lit(0).cast("long"))


def divergence(docs: DataFrame, rule: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs with lang, source and text.

    part `pair`: every other source of the language, by how far it differs.
    part `term`: the terms by which the source stands out most from its
    language, `top` at most.  Ranks go by value, then by the bytes of the item.
    Nulls count as empty, repeated rows as documents of their own; other columns
    don't matter.  A language without kept terms has pairs of value 0.  An
    empty table has no rows.  A value is exact while it fits in 64 bits.
    """
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    read = docs.select(*(filled[c].alias(c) for c in filled)).withColumn("text", F.make_valid_utf8("text"))
    kept = stored(by_shard(term_counts(read), KEEP.format(least=rule.least_docs), "lang string, source string, term string, n long, lang_n long, lead boolean"), "kept-terms")
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count("*").alias("n_terms"))
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("v"))
    groups = read.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    smooth = F.lit(rule.smooth).cast("long")
    groups = groups.na.fill(0).select("*", (F.col("source_total") + smooth * F.col("v")).alias("below"), (F.col("lang_total") + smooth * F.col("v")).alias("lang_below"))
    groups = stored(groups.withColumn("z", share(smooth, F.col("below"), rule)), "sources")

    shares = kept.join(groups.select("lang", "source", "below", "lang_below", "z"), ["lang", "source"])
    shares = shares.withColumns({"p": share(F.col("n") + smooth, F.col("below"), rule), "q": share(F.col("lang_n") + smooth, F.col("lang_below"), rule)})
    both = by_shard(shares.select("lang", "source", "term", "p", "z"), PAIRS, "lang string, source string, other string, both long")
    both = both.groupBy("lang", "source", "other").agg(F.sum("both").alias("both"))

    # terms of a source against the z of another: closed where that is no greater, else by how often each share occurs
    rest = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("times"))
    above = F.sum((F.col("p") - F.col("z")) * F.col("times"))
    alone = groups.join(rest.groupBy("lang", "source").agg(above.alias("above")), ["lang", "source"], "left").na.fill(0)
    higher = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"))
    gap = F.abs(F.col("p") - F.col("other_z")) - (F.col("other_z") - F.col("z"))
    beyond = rest.join(higher, "lang").where("other_z > z").groupBy("lang", "source", "other").agg(F.sum(gap * F.col("times")).alias("beyond"))

    ends = alone.select("lang", "source", "z", "v", "above")
    pairs = ends.join(ends.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("above").alias("other_above")), "lang").where("source <> other")
    pairs = pairs.join(beyond, ["lang", "source", "other"], "left").join(beyond.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("beyond").alias("other_beyond")), ["lang", "source", "other"], "left")
    pairs = pairs.join(both.select("lang", "source", "other", "both").unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "both")), ["lang", "source", "other"], "left")
    one = F.when(F.col("other_z") > F.col("z"), F.coalesce("beyond", F.lit(0))).otherwise(F.col("above"))
    two = F.when(F.col("z") > F.col("other_z"), F.coalesce("other_beyond", F.lit(0))).otherwise(F.col("other_above"))
    value = F.col("v") * F.abs(F.col("z") - F.col("other_z")) + one + two + F.coalesce("both", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value"))

    tops = by_shard(shares.select("lang", "source", "term", "p", "q"), TOPS.format(top=rule.top), "lang string, source string, item string, value long")
    terms = tops.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, terms = (x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms))
    return pairs.unionByName(terms.where(F.col("rank") <= rule.top))
