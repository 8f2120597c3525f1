"""From laid-out blocks to identified chunks.

blocks: (paper_id, page, block, text, size, bold). A section unit is one row, so packing
needs no grouping: it is a map over units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import chunk_identity, normal_title, token_count
from tessera.operators.chunking import Packing, count_words, pack
from tessera.session import materialize, ship

# fixed values: what makes a block a heading
NUMBERED = r"^\s*(\d+(\.\d+)*)[\.\)]?\s+[A-Z]"
MAX_HEADING_CHARS, MAX_HEADING_WORDS = 90, 12
SIZE_MARGIN, MIN_ALPHA = 0.8, 0.5
FRONT_MATTER = "FRONT_MATTER"
DEFAULT_SIZE = 10.0
DROPPED_SECTIONS = ("references", "bibliography", "acknowledg", "appendix")
CONTEXT = " > "
SIMILAR = 0.92
SEGMENTED = 120  # letters of a title that is compared by segments; longer ones meet on triples


def body_size(blocks: DataFrame) -> DataFrame:
    """(paper_id, body_size): the most frequent rounded font size, the first seen of a tie."""
    counts = blocks.where("size is not null").groupBy("paper_id", F.round("size", 1).alias("s")).agg(
        F.count("*").alias("n"), F.min(F.struct("page", "block")).alias("seen")
    )
    first = F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("n"), "seen"))
    found = counts.withColumn("nth", first).where("nth = 1").select("paper_id", F.col("s").alias("body_size"))
    return blocks.select("paper_id").distinct().join(found, "paper_id", "left").na.fill(DEFAULT_SIZE, ["body_size"])


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Short, prose-like or numbered, and set apart by size or weight."""
    t = F.trim(text)
    short = (t != "") & (F.length(t) <= MAX_HEADING_CHARS) & (F.size(F.split(t, r"\s+")) <= MAX_HEADING_WORDS)
    apart = (size > body + SIZE_MARGIN) | (bold & (size >= body))
    prose = (F.regexp_count(t, F.lit(r"\p{L}")) / F.length(t) >= MIN_ALPHA) & t.rlike("[A-Za-z]{3,}")
    return F.coalesce(short & apart & (t.rlike(NUMBERED) | prose), F.lit(False))


def sectioned(blocks: DataFrame) -> DataFrame:
    """Body blocks with the section they stand in: the last heading, across pages."""
    marked = blocks.join(body_size(blocks), "paper_id").withColumn("heading", is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size")))
    w = W.partitionBy("paper_id").orderBy("page", "block").rowsBetween(W.unboundedPreceding, 0)
    section = F.last(F.when(F.col("heading"), F.trim("text")), ignorenulls=True).over(w)
    return marked.withColumn("section", F.coalesce(section, F.lit(FRONT_MATTER)))


def page_records(blocks: DataFrame, min_chars: int = 200, dropped: tuple[str, ...] = DROPPED_SECTIONS) -> DataFrame:
    """One record for each section segment of a page: text, n_chars, ordinal, and the
    advisory flags dropped (by section name) and thin (a page with little text)."""
    body = sectioned(blocks).where(~F.col("heading") & (F.trim("text") != ""))
    # a segment is a run of blocks of one section on one page
    w = W.partitionBy("paper_id", "page").orderBy("block")
    step = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")), 0).otherwise(1)
    runs = body.withColumn("step", step).withColumn("segment", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = runs.groupBy("paper_id", "page", "section", "segment").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))  # one page
    records = parts.select("paper_id", "page", "section", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "segment")
    records = records.withColumn("n_chars", F.length("text"))
    page = W.partitionBy("paper_id", "page")
    return records.select(
        "paper_id", "page", "section", "text", "n_chars",
        F.exists(F.array(*[F.lit(d) for d in dropped]), lambda d: F.contains(F.lower("section"), d)).alias("dropped"),
        (F.sum("n_chars").over(page) < min_chars).alias("thin"),
        (F.row_number().over(page.orderBy("segment")) - 1).alias("ordinal"),
    )


def kept_records(records: DataFrame, keep_thin: bool = False) -> DataFrame:
    rows = records.where(~F.col("dropped"))
    return rows if keep_thin else rows.where(~F.col("thin"))


def islands(records: DataFrame) -> DataFrame:
    """Runs of records of one paper and section, in reading order: (paper_id, unit, section,
    text, page_start, page_end, pages, page_offsets). A later recurrence of a name is a new
    unit."""
    w = W.partitionBy("paper_id").orderBy("page", "ordinal")
    step = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")), 0).otherwise(1)
    rows = records.withColumn("step", step).withColumn("unit", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy("paper_id", "unit", "section").agg(F.array_sort(F.collect_list(F.struct("page", "ordinal", "text"))).alias("p"))  # one section
    place = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<off:int,page:int>>").alias("o")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"]) + 1).cast("int").alias("at"),
            F.concat(acc["o"], F.array(F.struct(acc["at"].alias("off"), x["page"].cast("int").alias("page")))).alias("o"),
        ),
    )
    return parts.select(
        "paper_id", "unit", "section", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
        F.array_min(F.transform("p", lambda x: x["page"])).alias("page_start"), F.array_max(F.transform("p", lambda x: x["page"])).alias("page_end"),
        F.array_distinct(F.transform("p", lambda x: x["page"])).alias("pages"), place["o"].alias("page_offsets"),
    )


def page_at(page_offsets: Column, start: Column) -> Column:
    """The page of an offset: that of the greatest start at or before it."""
    return F.coalesce(
        F.try_element_at(F.filter(page_offsets, lambda x: x["off"] <= start), F.lit(-1))["page"], F.try_element_at(page_offsets, F.lit(1))["page"]
    )


def absorbed(units: DataFrame, least: int = 80, tokens: Column | None = None) -> DataFrame:
    """Units below ``least`` tokens join the unit that follows in their paper, at a paper's
    end the one before; offsets shift with the text. Only unit numbers are looked up across
    a paper; texts meet in groups of one large unit and the small ones that join it."""
    size = token_count("text") if tokens is None else tokens
    own = W.partitionBy("paper_id").orderBy("unit")
    heads = units.select("paper_id", "unit", F.when(size >= least, F.col("unit")).alias("big"))
    following = F.first("big", ignorenulls=True).over(own.rowsBetween(0, W.unboundedFollowing))
    last = F.max("big").over(W.partitionBy("paper_id"))
    heads = heads.select("paper_id", "unit", F.coalesce(following, last, "unit").alias("head"))
    rest = [c for c in units.columns if c not in ("paper_id", "unit")]
    parts = units.join(heads, ["paper_id", "unit"]).groupBy("paper_id", "head").agg(F.array_sort(F.collect_list(F.struct("unit", *rest))).alias("p"))
    kind = units.schema["page_offsets"].dataType.simpleString()
    shifted = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), kind).alias("o")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"]) + 1).cast("int").alias("at"),
            F.concat(acc["o"], F.transform(x["page_offsets"], lambda o: F.struct((acc["at"] + o["off"]).cast("int").alias("off"), o["page"].alias("page")))).alias("o"),
        ),
    )
    of = lambda name: F.transform("p", lambda x: x[name])
    main = F.element_at(F.filter("p", lambda x: x["unit"] == F.col("head")), 1)
    merged = {
        "unit": F.col("head"),
        "text": F.array_join(of("text"), "\n"),
        "page_start": F.array_min(of("page_start")),
        "page_end": F.array_max(of("page_end")),
        "pages": F.array_distinct(F.flatten(of("pages"))),
        "page_offsets": shifted["o"],
    }
    return parts.select(*[F.col(c) if c == "paper_id" else merged.get(c, main[c]).alias(c) for c in units.columns])


def build_chunks(units: DataFrame, manifest: DataFrame | None = None, size: Packing = Packing(), count: Callable[[str], int] = count_words) -> DataFrame:
    """Identified chunks of section units. The prefix ``title > section`` is part of a
    chunk's text and paid for from its budget, but not part of its offsets."""
    ship(units.sparkSession)
    if manifest is None:
        units = units.select("*", F.lit("").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("venue"))
    else:
        meta = manifest.select("paper_id", F.coalesce("title", F.lit("")).alias("title"), F.col("year").cast("int"), F.col("venue").cast("string"))
        units = units.join(meta, "paper_id", "left").na.fill("", ["title"])
    kept = ["paper_id", "title", "year", "venue", "section", "page_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, (title, section, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("title", "section", "text")))):
                prefix = f"{title}{CONTEXT}{section}\n"
                paid = count(prefix)
                for c in pack(text, size.less(paid), count):
                    at.append(i)
                    made.append((prefix + c.text, c.start, c.end, paid + c.tokens if count is count_words else count(prefix + c.text)))
            rows = batch.select(kept).take(pa.array(at, pa.int64()))
            columns = list(zip(*made)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, "text", "char_start", "char_end", "n_tokens"])

    needed = units.select(F.col("paper_id").cast("string"), *kept[1:], "text")
    schema = T.StructType([*needed.select(*kept).schema.fields, *T._parse_datatype_string("text string, char_start int, char_end int, n_tokens int").fields])
    return needed.mapInArrow(run, schema).select(
        chunk_identity("paper_id", "char_start", "char_end", "text").alias("chunk_id"),
        "paper_id", "title", "year", "venue", "section", "text", "char_start", "char_end", "n_tokens",
        page_at(F.col("page_offsets"), F.col("char_start")).alias("page"),
    )


def fixed_windows(tokens: DataFrame, target: int = 350) -> DataFrame:
    """(paper_id, window, first, last, n) of (paper_id, pos, n_tokens): windows by the
    running token count, the variant without a packer."""
    w = W.partitionBy("paper_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = tokens.withColumn("window", F.floor((F.sum("n_tokens").over(w) - F.col("n_tokens")) / target))
    return rows.groupBy("paper_id", "window").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("n_tokens").alias("n"))


def canonical_exact(titles: DataFrame) -> DataFrame:
    """(paper_id, canonical_id): the smallest id among papers of one normal title."""
    one = titles.select("paper_id", normal_title("title").alias("nt"))
    least = one.where("nt <> ''").groupBy("nt").agg(F.min("paper_id").alias("least"))
    return one.join(least, "nt", "left").select("paper_id", F.coalesce("least", "paper_id").alias("canonical_id"))


def _met_on_segments(t: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, a_t, b, b_t) of titles (paper_id, nt, n) that may reach ``ratio``; a is the shorter.

    At most d letters of both are outside the blocks matched. The shorter title is cut into
    d + 1 segments. Going from the left there is a first place where no more of these letters
    were met than segments passed: the segment there is whole in the longer title, shifted by
    at most its number i, and at most d - i from the right. So titles meet on a segment and its
    place, once for each pair of lengths.
    """
    # letters outside; of the parity of the lengths' difference
    d = F.expr(f"int(floor({1 - ratio!r}D * (n + m) + 1e-6))")
    lengths = t.select("n").distinct()  # at most SEGMENTED rows
    # a small table whose rows are much work each
    t = t.select(F.col("paper_id").alias("id"), "nt", F.col("n").alias("own")).repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = "substring(nt, int(floor(n * i / (d + 1))) + 1 + shift, int(floor(n * (i + 1) / (d + 1))) - int(floor(n * i / (d + 1))))"

    def keyed(rows: DataFrame, other: str, name: str, shifts: str) -> DataFrame:
        rows = rows.join(F.broadcast(lengths.withColumnRenamed("n", other)), other, "left_semi").withColumn("d", d).withColumn("d", F.expr("d - (d - (m - n)) % 2")).where("d >= m - n")
        inside = "int(floor(n * i / (d + 1))) + shift >= 0 and int(floor(n * (i + 1) / (d + 1))) + shift <= own"
        keys = F.expr(f"array_distinct(transform(filter({shifts}, shift -> {inside}), shift -> xxhash64(n, m, i, {cut})))")
        return rows.withColumn("i", F.explode(F.expr("sequence(0, d)"))).select(F.explode(keys).alias("key"), "d", F.col("id").alias(name), F.col("nt").alias(f"{name}_t"))

    most = f"int(floor(own * {2 - ratio!r}D / {ratio!r}D + 1e-6))"
    least = f"int(ceil(own * {ratio!r}D / {2 - ratio!r}D - 1e-6))"
    short = t.withColumn("n", F.col("own")).withColumn("m", F.explode(F.expr(f"sequence(own, {most})")))
    long_ = t.withColumn("m", F.col("own")).withColumn("n", F.explode(F.expr(f"sequence({least}, own)")))
    a = keyed(short, "m", "a", "array(0)")
    b = keyed(long_, "n", "b", "sequence(greatest(-i, (m - n) - (d - i)), least(i, (m - n) + (d - i)))").drop("d")
    # two titles of one length meet in both roles: one is enough
    own = (F.length("a_t") < F.length("b_t")) | (F.col("a") < F.col("b"))
    # a title has some hundred keys, which Spark's size check does not know: without the hint it broadcasts them
    return a.join(b.hint("merge"), "key").where(own).where(F.expr("levenshtein(a_t, b_t, d) >= 0")).select("a", "a_t", "b", "b_t")


def _met_on_grams(t: DataFrame, ratio: float) -> DataFrame:
    """The same for long titles, which meet on their rarest letter triples.

    A triple of a title that lies in none of the blocks matched with another title has an
    unmatched letter (at most 3 for each) or spans a place where the other has one (2 for
    each), and the letters that both may leave unmatched are bounded by the ratio, with the
    lengths of the longest and the shortest admissible partner as the two extremes. One more
    triple than that is a shared one. Below a ratio of 0.91 a short title may share no triple
    with a similar one, so titles meet on any letter then.
    """
    width = 3 if ratio >= 0.91 else 1
    t = t.where(F.col("n") >= SEGMENTED * ratio / (2 - ratio) - 1e-6)
    grams = t.select(
        "paper_id", "nt", "n",
        F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1))), lambda i: F.substring("nt", i, F.lit(width))))).alias("g"),
    )
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    rare = grams.join(df, "g").withColumn("nth", F.row_number().over(W.partitionBy("paper_id").orderBy("df", "g")))
    if width == 3:
        unshared = max(6 * (1 - ratio) / (2 - ratio), 4 * (1 - ratio) / ratio)  # of a title's length
        rare = rare.where(F.col("nth") <= F.floor(unshared * F.col("n") + 1e-6) + 1)
    a, b = (rare.select(F.col("paper_id").alias(f"{x}"), F.col("nt").alias(f"{x}_t"), F.col("n").alias(f"{x}_n"), "g") for x in ("a", "b"))
    near = F.least("a_n", "b_n") * 2 >= ratio * (F.col("a_n") + F.col("b_n"))
    # the same for triples
    return a.join(b.hint("merge"), "g").where((F.col("a") < F.col("b")) & near & (F.greatest("a_n", "b_n") > SEGMENTED)).select("a", "a_t", "b", "b_t")


def similar_titles(titles: DataFrame, ratio: float = SIMILAR) -> DataFrame:
    """(later, earlier): pairs of normal titles whose matching ratio reaches ``ratio``. Only
    titles that meet on a segment, or long ones on a rare triple, are compared."""
    ship(titles.sparkSession)
    t = titles.select("paper_id", normal_title("title").alias("nt")).where("nt <> ''").withColumn("n", F.length("nt"))
    met = _met_on_segments(t.where(F.col("n") <= SEGMENTED), ratio).unionByName(_met_on_grams(t, ratio))
    late = F.col("a") > F.col("b")
    pairs = met.select(
        F.when(late, F.col("a")).otherwise(F.col("b")).alias("later"), F.when(late, F.col("b")).otherwise(F.col("a")).alias("earlier"),
        F.when(late, F.col("a_t")).otherwise(F.col("b_t")).alias("later_t"), F.when(late, F.col("b_t")).otherwise(F.col("a_t")).alias("earlier_t"),
    ).distinct()

    @F.pandas_udf("boolean")
    def matching(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(p: str, q: str) -> bool:
            m = SequenceMatcher(None, p, q)
            return m.quick_ratio() >= ratio and m.ratio() >= ratio  # the first is never less

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="bool")

    return pairs.where(matching("later_t", "earlier_t")).select("later", "earlier")


def canonical_fuzzy(titles: DataFrame, ratio: float = SIMILAR, max_rounds: int = 100) -> DataFrame:
    """(paper_id, canonical_id): in order of paper_id, a paper takes the id of the first
    earlier canonical paper with a similar title, or else is canonical itself.

    Papers of one normal title share their fate: none of them but the first can be
    canonical, and the first's canonical paper is the first for all. So only the first of
    each title is compared. Every round settles those all of whose earlier similar titles
    are settled. A paper without a title is canonical.
    """
    named = titles.select("paper_id", normal_title("title").alias("nt")).distinct()
    first = materialize(named.where("nt <> ''").groupBy("nt").agg(F.min("paper_id").alias("first")), "titles")
    links = materialize(similar_titles(first.select(F.col("first").alias("paper_id"), F.col("nt").alias("title")), ratio), "title-links")
    # most titles are like no other: the rounds are over those that are like an earlier one, or are
    open_ = links.select(F.col("later").alias("paper_id")).union(links.select(F.col("earlier").alias("paper_id"))).distinct()
    state = materialize(open_.withColumn("canonical_id", F.lit(None).cast(titles.schema["paper_id"].dataType)), "canonical")
    for _ in range(max_rounds):
        if not state.where("canonical_id is null").limit(1).count():
            break
        known = state.select(F.col("paper_id").alias("earlier"), "canonical_id")
        seen = links.join(known, "earlier").groupBy(F.col("later").alias("paper_id")).agg(
            # an open paper before the first canonical one may turn out to be canonical
            F.min(F.when(F.col("canonical_id").isNull(), F.col("earlier"))).alias("first_open"),
            F.min(F.when(F.col("canonical_id") == F.col("earlier"), F.col("earlier"))).alias("first_canonical"),
        )
        rows = state.join(seen, "paper_id", "left")
        certain = F.col("first_canonical").isNotNull() & (F.col("first_open").isNull() | (F.col("first_canonical") < F.col("first_open")))
        now = F.when(F.col("canonical_id").isNotNull(), F.col("canonical_id")).when(certain, F.col("first_canonical")).when(
            F.col("first_open").isNull() & F.col("first_canonical").isNull(), F.col("paper_id")
        )
        state = materialize(rows.select("paper_id", now.alias("canonical_id")), "canonical")
    else:
        raise RuntimeError("canonical ids did not settle")
    settled = first.join(state.withColumnRenamed("paper_id", "first"), "first", "left").select("nt", F.coalesce("canonical_id", "first").alias("canonical_id"))
    return named.join(settled, "nt", "left").select("paper_id", F.coalesce("canonical_id", "paper_id").alias("canonical_id"))


def exclusive_quartiles(values: DataFrame, value: str = "v") -> DataFrame:
    """One row: n, min, p25, median, p75, max, mean, with quartiles by the exclusive method
    (rounded to one place). Equal values are counted first and dealt out by range: running
    sums are made in each range, and over one row a range."""
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    counted = materialize(counted.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "quartiles")
    before = counted.groupBy("part").agg(F.sum("c").alias("of_part")).withColumn(
        "before", F.sum("of_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("of_part")
    )
    inside = W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ends = counted.withColumn("own", F.sum("c").over(inside)).join(before, "part").withColumn("upto", F.col("before") + F.col("own"))
    n = counted.agg(
        F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean")
    )
    spots = n.select("n", "min", "max", "mean", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3)])).alias("q"))
    j = F.least(F.greatest(F.floor((F.col("n") + 1) * F.col("q") / 4), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    spots = spots.withColumn("j", j).withColumn("d", (F.col("n") + 1) * F.col("q") / 4 - F.col("j"))
    at = ends.select(F.col(value).alias("at_value"), (F.col("upto") - F.col("c")).alias("after"), "upto")

    def pick(nth: Column, name: str) -> DataFrame:
        asked = spots.select(F.col("q"), nth.alias("nth"))  # three rows
        return at.join(F.broadcast(asked), (F.col("after") < F.col("nth")) & (F.col("nth") <= F.col("upto"))).groupBy("q").agg(F.max("at_value").alias(name))

    lo = pick(F.col("j"), "lo")
    hi = pick(F.least(F.col("j") + 1, F.col("n")), "hi")
    both = spots.join(lo, "q").join(hi, "q").withColumn("value", F.round(F.when(F.col("n") == 1, F.col("lo")).otherwise(F.col("lo") * (1 - F.col("d")) + F.col("hi") * F.col("d")), 1))
    part = lambda q, name: F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
    return both.groupBy("n", "min", "max", "mean").agg(part(1, "p25"), part(2, "median"), part(3, "p75"))


def parse_report(records: DataFrame) -> DataFrame:
    """Per paper: pages, records, kept records, thin pages, sorted sections."""
    kept = ~F.col("dropped") & ~F.col("thin")
    return records.groupBy("paper_id").agg(
        F.count_distinct("page").alias("pages"),
        F.count("*").alias("records"),
        F.count_if(kept).alias("kept"),
        F.count_distinct(F.when(F.col("thin"), F.col("page"))).alias("thin_pages"),
        F.array_sort(F.collect_set("section")).alias("sections"),  # one paper's
    )


def chunk_counts(report: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"))
    return report.join(counts, "paper_id", "left").na.fill(0, ["chunks"])


def chunk_bounds(chunks: DataFrame, least: int = 80, most: int = 700) -> DataFrame:
    """Per paper of (paper_id, n_tokens): chunks, how many are below and above the bounds."""
    n = F.col("n_tokens")
    return chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"), F.count_if(n < least).alias("under"), F.count_if(n > most).alias("over"))


def with_manifest(records: DataFrame, manifest: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Records with title, year and venue of their paper, and its canonical id. A paper that
    the manifest lacks has an empty title and is its own canonical paper."""
    rows = records.join(manifest.select("paper_id", "title", "year", "venue"), "paper_id", "left").na.fill("", ["title"])
    if canonical is None:
        return rows.withColumn("canonical_id", F.col("paper_id"))
    return rows.join(canonical.select("paper_id", "canonical_id"), "paper_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "paper_id"))
