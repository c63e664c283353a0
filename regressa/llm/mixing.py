"""Mixing sources to target word counts by entropy balancing.

Among all rates that bring each source to its target, the mix takes those closest in entropy to
taking every document once, with no document above ``most`` times. Their dual has one multiplier
a source: a document of ``x`` (its words in units of its source's mean) gets the rate
``min(most, exp(t * x))``. Newton's method on the logarithm of the words taken, kept inside a
bracket, finds all multipliers together; an iteration is one aggregation of the table of distinct
(source, size), which is far smaller than the documents and exact. Rates then become copies: by
size within the source the expected copies are rounded so that their running sum is kept, and the
few words that are left over are settled with the copies of one size that come closest, again and
again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regressa.llm.common import keep, quoted, row_numbers, shared_path, text_or_empty

WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Relative error of a source's words, digits of the multiplier that later steps use (far above
#: what the order of a sum can change, so that reruns agree), and iterations after which the dual
#: counts as failed: halving the bracket alone needs fewer.
ERROR, DIGITS, ROUNDS = 1e-11, 6, 400


def sizes(docs: DataFrame, text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def histogram(sized: DataFrame) -> DataFrame:
    """``(source, size, n)``: documents of each size in each source; null sources are one."""
    return sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(hist: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL,
            most: float = MOST) -> DataFrame:
    """``(source, words, target)``. Sources share ``total`` times all words by weight; what goes
    above ``most`` times a source's own words is shared again among the others."""
    per = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    place = row_numbers(per, "place", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = keep(place.withColumn("weight", weight).withColumn("cap", F.col("words") * F.lit(most)))
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        row = per.agg(F.sum("words").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("cap"),
                      F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                      F.count(F.when(full, True)).alias("full")).first()
        if row["full"] == held or not row["weight"]:
            break
        held = row["full"]
        level = (total * row["all"] - (row["cap"] or 0.0)) / row["weight"]
    return per.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))) \
        .select("source", "words", "docs", "least", "target")


def multipliers(hist: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``(source, unit, t)``: the dual's solution, rounded to ``DIGITS`` digits."""
    full = F.col("target") >= F.col("words") * F.lit(most)
    top = F.lit(math.log(most)) * F.col("unit") / F.col("least")  # here every rate is the most
    over = F.col("target") > F.col("words")
    state = keep(goals.where("words > 0").withColumn("unit", F.col("words") / F.col("docs"))
                 .withColumn("t", F.when(full, top).otherwise(0.0))
                 .withColumn("low", F.when(over, 0.0)).withColumn("high", F.when(over, top).otherwise(0.0))
                 .withColumn("done", full | (F.col("target") == F.col("words"))))
    x = F.col("size") / F.col("unit")
    rate = F.least(F.lit(most), F.exp(F.col("t") * x))
    taken = F.col("size") * F.col("n") * rate
    for _ in range(ROUNDS):
        sums = hist.alias("h").join(state.where("NOT done").alias("o"),
                                    F.col("h.source").eqNullSafe(F.col("o.source"))) \
            .groupBy("o.source").agg(
                F.sum(taken).alias("g"),
                F.sum(F.when(rate < F.lit(most), taken * x).otherwise(0.0)).alias("slope"))
        old, new = state.alias("o"), sums.alias("s")
        off = F.log("g") - F.log("target")
        low, high = F.when(off > 0, F.col("low")).otherwise(F.col("t")), F.when(
            off > 0, F.col("t")).otherwise(F.col("high"))
        newton = F.col("t") - off * F.try_divide(F.col("g"), F.col("slope"))
        inside = newton.isNotNull() & (newton < high) & (low.isNull() | (newton > low))
        # Without a lower end yet, the step doubles the way down.
        step = F.when(inside, newton).otherwise(F.coalesce((low + high) / 2, 2 * high - 1))
        small = F.abs(off) < ERROR
        moved = old.join(new, F.col("o.source").eqNullSafe(F.col("s.source")), "left")
        state = keep(moved.select(
            "o.source", "words", "docs", "least", "target", "unit",
            F.when(F.col("done") | small, F.col("t")).otherwise(step).alias("t"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            # A step that no longer changes the multiplier has found it as well.
            (F.col("done") | small | (F.abs(step - F.col("t")) <= 1e-14 * F.abs(F.col("t"))))
            .alias("done")))
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"the multipliers did not converge in {ROUNDS} iterations")
    return state.select("source", "unit", F.round("t", DIGITS).alias("t"),
                        full.alias("full"))


def cells(hist: DataFrame, goals: DataFrame, dual: DataFrame, most: float = MOST) -> DataFrame:
    """``(source, size, n, words, target, rate, copies)``: copies that all documents of a size in a
    source have together."""
    a, g, d = hist.alias("a"), goals.alias("g"), dual.alias("d")
    rated = a.join(g, F.col("a.source").eqNullSafe(F.col("g.source"))) \
        .join(d, F.col("a.source").eqNullSafe(F.col("d.source")), "left") \
        .select("a.source", "size", "n", "words", "target",
                F.when(F.col("size") == 0, 1.0).when(F.col("full"), F.lit(most)).otherwise(
                    F.least(F.lit(most), F.exp(F.col("t") * F.col("size") / F.col("unit"))))
                .alias("rate"))
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    run = F.sum(F.col("n") * F.col("rate")).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    upto = F.floor(run + 0.5)
    made = rated.withColumn("upto", upto).withColumn(
        "copies", F.col("upto") - F.coalesce(F.lag("upto").over(by_size), F.lit(0))) \
        .withColumn("copies", F.greatest(F.lit(0), F.least(
            F.col("copies"), (F.col("n") * F.lit(most)).cast("long")))).drop("upto")
    made = keep(made)
    while True:  # every move leaves fewer words over
        left = made.groupBy("source").agg(
            (F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"))
        m, r = made.alias("m"), left.alias("r")
        room = F.when(F.col("left") > 0, (F.col("n") * F.lit(most)).cast("long") - F.col("copies")) \
            .otherwise(F.col("copies"))
        gap = F.abs("left")
        some = F.least(room, F.greatest(F.lit(1), F.floor(gap / F.col("size") + 0.5)))
        rest = F.abs(gap - some * F.col("size"))
        move = F.struct(rest.alias("rest"), (-F.col("size")).alias("larger"), F.col("size"),
                        (some * F.signum("left").cast("long")).alias("change"))
        moves = keep(m.join(r, F.col("m.source").eqNullSafe(F.col("r.source")))
                     .where((F.col("size") > 0) & (room > 0) & (rest < gap))
                     .groupBy(F.col("m.source").alias("source")).agg(F.min(move).alias("move")))
        if moves.isEmpty():
            break
        v = moves.alias("v")
        made = keep(m.join(v, F.col("m.source").eqNullSafe(F.col("v.source")) &
                           (F.col("m.size") == F.col("move.size")), "left")
                    .select("m.source", "m.size", "n", "words", "target", "rate",
                            (F.col("copies") + F.coalesce("move.change", F.lit(0))).alias("copies")))
    return made


def shares(sized: DataFrame, made: DataFrame) -> DataFrame:
    """Cells with ``base`` copies of every document and one more of those whose ``mark`` comes before
    ``last``; of the rows with that mark (equal rows share it), ``within`` get one more, of ``equal``
    there are. A cell may hold a third of all rows: equal rows are counted first, and the others are
    ranked in about sqrt(n) slices."""
    made = made.withColumn("base", F.floor(F.col("copies") / F.col("n"))) \
        .withColumn("more", F.pmod("copies", "n")) \
        .withColumn("slices", F.ceil(F.sqrt("n")).cast("long"))
    split = made.where("more > 0").select("source", "size", "more", "slices").alias("c")
    s = sized.groupBy("source", "size", "mark").agg(F.count(F.lit(1)).alias("equal")).alias("s")
    rows = s.join(split, F.col("s.source").eqNullSafe(F.col("c.source")) &
                  (F.col("s.size") == F.col("c.size"))) \
        .select("s.source", "s.size", "mark", "equal", "more", F.floor(
            (F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))) * F.col("slices")).alias("slice"),
            (F.col("mark") < 0).alias("upper"))
    # Marks are signed: slices follow the unsigned order, and so do ranks and the last mark.
    key = ["source", "size", "slice"]
    before = rows.groupBy(*key).agg(F.sum("equal").alias("m")).withColumn(
        "before", F.sum("m").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("m"))
    rows, before = rows.alias("r"), before.alias("b")
    order = Window.partitionBy("r.source", "r.size", "r.slice").orderBy("upper", "mark")
    last = rows.join(before, F.col("r.source").eqNullSafe(F.col("b.source")) &
                     (F.col("r.size") == F.col("b.size")) & (F.col("r.slice") == F.col("b.slice"))) \
        .where(F.col("before") < F.col("more")) \
        .select("r.source", "r.size", "mark", "more", "equal",
                (F.sum("equal").over(order) + F.col("before")).alias("upto")) \
        .where("upto >= more AND upto - equal < more") \
        .select("source", "size", F.col("mark").alias("last"), "equal",
                (F.col("more") - F.col("upto") + F.col("equal")).alias("within")).alias("l")
    m = made.alias("m")
    return m.join(last, F.col("m.source").eqNullSafe(F.col("l.source")) &
                  (F.col("m.size") == F.col("l.size")), "left") \
        .select("m.source", "m.size", "words", "target", "rate", "base", "last", "equal", "within")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
                total: float = TOTAL, most: float = MOST, name: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``name``: size, source_size, target, rate, copies.

    Null texts have size 0, documents of size 0 are taken once and add nothing; a null source is a
    source, the last one. Rows that repeat an id and a text count as so many documents, of which as
    many are taken as the target asks for; null ids are told apart by their texts. Sources without
    words have target 0. An empty table stays empty. A column of that name is an error.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column {name!r} already")
    return _copied(_sized(docs, id_col, text_col, source_col, name), docs.columns, weights, total,
                   most, name)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, name: str) -> DataFrame:
    return docs.withColumn(name, F.struct(
        F.col(quoted(source_col)).alias("source"), sizes(docs, text_col).alias("size"),
        F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col))).alias("mark")))


def _copied(whole: DataFrame, columns: list[str], weights: tuple[float, ...], total: float,
            most: float, name: str) -> DataFrame:
    spark, own = whole.sparkSession, F.col(quoted(name))
    sized = keep(whole.select(own["source"].alias("source"), own["size"].alias("size"),
                              own["mark"].alias("mark")))
    hist = keep(histogram(sized))
    goals = keep(targets(hist, weights, total, most))
    made = cells(hist, goals, multipliers(hist, goals, most), most)
    # One row a (source, size): written, so that the planner knows its size and need not move rows.
    path = shared_path(spark, "shares")
    shares(sized, made).write.parquet(path)
    part = spark.read.parquet(path)
    p = F.struct(*[F.col(f"c.{c}").alias(c) for c in part.columns])
    mine = F.col(f"w.{quoted(name)}")
    rows = whole.alias("w").join(
        part.alias("c"), mine["source"].eqNullSafe(F.col("c.source")) & (mine["size"] == F.col("c.size"))) \
        .select(*[F.col(f"w.{quoted(c)}") for c in columns], F.struct(
            mine["mark"].alias("mark"), p.alias("p")).alias(name))
    mark, at = own["mark"], own["p"]
    # Unsigned comparison of the marks, by their upper bit first.
    taken = at["last"].isNotNull() & F.when(
        (mark < 0) == (at["last"] < 0), mark <= at["last"]).otherwise(at["last"] < 0)
    cut = part.where("within < equal")
    if not cut.isEmpty():
        # A limit falls among equal rows: these are numbered.
        among = F.coalesce((mark == at["last"]) & (at["within"] < at["equal"]), F.lit(False))
        few = _numbered(rows.where(among), name)
        rest = rows.where(~among).withColumn(name, F.struct(at.alias("p"), taken.alias("taken")))
        rows = rest.unionByName(few.withColumn(
            name, F.struct(at.alias("p"), (own["number"] <= at["within"]).alias("taken"))))
    else:
        rows = rows.withColumn(name, F.struct(at.alias("p"), taken.alias("taken")))
    return rows.withColumn(name, F.struct(
        at["size"].alias("size"), at["words"].alias("source_size"), at["target"].alias("target"),
        at["rate"].alias("rate"), (at["base"] + own["taken"].cast("long")).alias("copies")))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``number`` in their struct: from 1 within their (source, size), in any order. A
    group may hold a third of all rows: a partition counts its own and adds those before it."""
    own = F.col(quoted(name))
    rows = keep(rows.withColumn(name, F.struct(own["mark"].alias("mark"), own["p"].alias("p"),
                                               F.spark_partition_id().alias("at"))))
    key = [own["p"]["source"], own["p"]["size"], own["at"]]
    counts = rows.groupBy(*[k.alias(c) for k, c in zip(key, "abc", strict=True)]) \
        .agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("before", F.sum("m").over(Window.partitionBy("a", "b").orderBy("c"))
                               - F.col("m")).alias("n")
    own = F.col(f"r.{quoted(name)}")
    here = Window.partitionBy(own["p"]["source"], own["p"]["size"], own["at"]).orderBy(own["at"])
    joined = rows.alias("r").join(
        counts, own["p"]["source"].eqNullSafe(F.col("n.a")) & (own["p"]["size"] == F.col("n.b")) &
        (own["at"] == F.col("n.c")))
    return joined.select(*[F.col(f"r.{quoted(c)}") for c in rows.columns if c != name], F.struct(
        own["mark"].alias("mark"), own["p"].alias("p"),
        (F.row_number().over(here) + F.col("n.before")).alias("number")).alias(name))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    name = _free(docs, "mix")
    copy = _free(docs, "copy")
    made = with_copies(docs, **options, name=name).where(F.col(quoted(name))["copies"] > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(quoted(name))["copies"])).alias(copy)
    return made.select(*[F.col(quoted(c)) for c in docs.columns], each).drop(copy)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
           total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), rate, copies; one row for each row."""
    # Without the texts the sized rows are small: they are kept, and texts are read once.
    thin = keep(_sized(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"),
                                   F.col(quoted(source_col)).alias("source")),
                       "doc_id", "text", "source", "mix").select("doc_id", "mix"))
    return _copied(thin, ["doc_id"], weights, total, most, "mix").select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"), "mix.rate", "mix.copies")
