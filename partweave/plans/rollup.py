"""Dashboard measures kept as sums that batches add to (Q1-Q8), instead of a scan of every table for every question.

The state is one row a cell: (measure, key, member, value).  A batch gives the rows it changed as they were and as they
are (``sign`` 1 and -1); each row adds its cells, the old form with the sign turned.  So appends, updates and reversals are all sums.  Exact
distinct counts, minima and maxima are kept as members with the number of rows that hold them: a member whose number
falls to nought leaves the set.

Cells are partially aggregated on the map side and lie in hash buckets (``sources.buckets``): those of codes by the code,
matched records by the record, the few others apart, so a batch of pairs leaves the codes' buckets alone.  A batch writes its
cells once, moves them and those of the buckets they touch by bucket in one shuffle, and rewrites these buckets; the switch
to the new state is atomic.  The names of the batches are kept with the state, so one that is
added again changes nothing.

Rows of a batch, each with one row per key:
records(record_id, org, category, completeness, flags, missing_required, expansions, cnmc, price, qty), cnmc being the
code of the active mapping or null; pairs(pair_key, a_record_id, b_record_id, a_org, b_org, category, match_type, vetoed,
status, decided_at, waiting); canonical(cnmc, category, status); events(action)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import half_up
from ..masters import POSITIVE
from ..session import cut_lineage
from ..sources.buckets import BucketedTable
from .dashboard import MATCH_TYPE_ORDER, has_uom_issue

VALUE = "decimal(38,9)"


def _cell(measure: str, key=None, member=None, value=None, when: Column | None = None) -> Column:
    value = (F.lit(1) if value is None else value).cast(VALUE)
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(measure).alias("measure"), text(key).alias("key"), text(member).alias("member"),
                    (value if when is None else F.when(when, value)).alias("value"))


def _alike(rows: DataFrame, cells: list[Column], more: Column | None = None, **columns: Column) -> DataFrame:
    """Cells of few keys: rows that are alike in ``columns`` are counted first, and one of them gives the cells of all."""
    n = F.sum("sign").cast(VALUE)
    alike = rows.groupBy(*[c.alias(name) for name, c in columns.items()]).agg(n.alias("n"))
    array = F.array(*cells) if more is None else F.concat(F.array(*cells), more)
    found = alike.select("n", F.explode(array).alias("c")).select("n", "c.*").filter("value is not null")
    return found.groupBy("measure", "key", "member").agg(F.sum((F.col("value") * F.col("n")).cast(VALUE)).cast(VALUE).alias("value"))


def _each(rows: DataFrame, key: Column, member: Column | None = None, **measures: Column) -> DataFrame:
    """Cells of many keys: one group a key and member gives the sums of all ``measures``, without a row for each of them."""
    names = ["key"] if member is None else ["key", "member"]
    sums = rows.groupBy(key.cast("string").alias("key"), *([] if member is None else [member.cast("string").alias("member")])).agg(
        *[F.sum((v * F.col("sign")).cast(VALUE)).cast(VALUE).alias(m) for m, v in measures.items()])
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    return sums.select(*names, F.explode(cells).alias("c")).select(
        "c.measure", "key", (F.lit(None).cast("string") if member is None else F.col("member")).alias("member"), "c.value").filter(
        "value is not null")


def record_cells(rows: DataFrame) -> list[DataFrame]:
    org, family, mapped, issue, complete = (F.col(c) for c in ("org", "category", "mapped", "issue", "completeness"))
    known = family.isNotNull()
    classified = family != "UNCLASSIFIED"
    cells = [
        _cell("records"), _cell("org_records", org), _cell("org", member=org, when=org.isNotNull()), _cell("normalized", when=known),
        _cell("family_records", family, when=known), _cell("mapped", when=mapped), _cell("family_mapped", family, when=mapped),
        _cell("org_mapped", org, when=mapped), _cell("insufficient", when=F.col("insufficient")),
        _cell("unclassified", when=family == "UNCLASSIFIED"), _cell("classified", when=~family.isin("UNCLASSIFIED", "PENDING")),
        _cell("uom_issues", when=issue), _cell("org_uom_issues", org, when=issue), _cell("abbreviations", value=F.col("expansions")),
        _cell("completeness", value=complete, when=classified), _cell("completeness_rows", when=classified & complete.isNotNull()),
        _cell("org_completeness", org, value=complete), _cell("org_completeness_rows", org, when=complete.isNotNull())]
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: _cell(
        "flag", F.split_part(f, F.lit(":"), F.lit(1))))
    few = _alike(rows, cells, flags, org=org, category=family, completeness=complete, flags=F.col("flags"),
                 mapped=F.col("cnmc").isNotNull(), insufficient=F.size("missing_required") > 0, expansions=F.size("expansions"),
                 issue=F.coalesce(has_uom_issue(F.col("flags")), F.lit(False)))
    coded, code, one = rows.filter("cnmc is not null"), F.col("cnmc"), F.lit(1)
    value = lambda c: c.cast(VALUE)
    return [few, _each(coded, code, codes=one, qty=value(F.col("qty")), spend=value(F.col("price") * F.col("qty"))),
            _each(coded.filter("org is not null"), code, F.col("org"), code_org=one),
            _each(coded.filter("price is not null"), code, F.col("price"), code_price=one)]


def pair_cells(rows: DataFrame) -> list[DataFrame]:
    family, status, day = F.col("category"), F.col("status"), F.col("day")
    positive = F.col("match_type").isin(POSITIVE)
    cells = [
        _cell("match_type", F.col("match_type")), _cell("duplicates", when=positive), _cell("family_duplicates", family, when=positive),
        _cell("functional", when=F.col("match_type") == "FUNCTIONALLY_EQUIVALENT"), _cell("vetoes", when=F.col("vetoed")),
        _cell("approved", when=status == "APPROVED"), _cell("rejected", when=status == "REJECTED"),
        _cell("day_approved", day, when=(status == "APPROVED") & day.isNotNull()),
        _cell("day_rejected", day, when=(status == "REJECTED") & day.isNotNull()),
        _cell("pending", when=F.col("waiting")), _cell("family_pending", family, when=F.col("waiting"))]
    orgs = F.filter(F.array_distinct(F.array("a_org", "b_org")), lambda o: o.isNotNull())
    few = _alike(rows, cells, F.transform(orgs, lambda o: _cell("org_pending", o, when=F.col("waiting"))), day=F.to_date("decided_at"), **{
        c: F.col(c) for c in ("category", "status", "match_type", "vetoed", "waiting", "a_org", "b_org")})
    ends = rows.filter(F.col("match_type") != "NOT_MATCHED").select("sign", F.explode(F.array("a_record_id", "b_record_id")).alias("member"))
    return [few, _each(ends, F.lit(None), F.col("member"), matched=F.lit(1))]


def canonical_cells(rows: DataFrame) -> list[DataFrame]:
    live = rows.filter("status = 'APPROVED'")
    return [_alike(live, [_cell("canonical"), _cell("family_canonical", F.col("category"))], category=F.col("category")),
            _each(live, F.col("cnmc"), F.col("category"), code_family=F.lit(1))]


OF_CODES = ["codes", "qty", "spend", "code_org", "code_price", "code_family"]
CELLS = {"records": record_cells, "pairs": pair_cells, "canonical": canonical_cells,
         "events": lambda rows: [_alike(rows, [_cell("audit_events")], one=F.lit(1))]}


def contributions(after: dict[str, DataFrame], before: dict[str, DataFrame]) -> list[DataFrame]:
    """Cells of a batch, each once: no two of the parts have a measure in common."""
    parts = []
    for name, cells in CELLS.items():
        rows = [df[name].withColumn("sign", F.lit(sign)) for df, sign in ((after, 1), (before, -1)) if name in df]
        if rows:
            parts += cells(reduce(lambda a, b: a.unionByName(b), rows))
    return [p.select("measure", "key", "member", "value").filter("value <> 0") for p in parts]


class Rollup:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        measure, apart = F.col("measure"), max(1, buckets // 8)
        dealt = lambda c, n, after: F.pmod(F.xxhash64(c), F.lit(n)) + after
        self.place = F.when(measure.isin(OF_CODES), dealt("key", buckets, 0)).when(
            measure == "matched", dealt("member", buckets, buckets)).otherwise(dealt("key", apart, 2 * buckets)).cast("int")
        self.table = BucketedTable(spark, path, "key", place=self.place)

    def add(self, batch: str, after: dict[str, DataFrame], before: dict[str, DataFrame] | None = None) -> bool:
        """Add what a batch changed; False if the batch is in the state already."""
        meta = self.table.state()["meta"] or {"batches": []}
        if batch in meta["batches"]:
            return False
        parts = contributions(after, before or {})
        total = lambda df, *by: df.groupBy(*by, "measure", "key", "member").agg(F.sum("value").cast(VALUE).alias("value")).filter(
            "value <> 0").drop(*by)
        cells = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
        merged = lambda old, new: total(old.unionByName(new).withColumn("place", self.place).repartition("place"), "place")
        self.table.upsert(cells, merge=merged, meta={"batches": [*meta["batches"], batch]}, dealt=True)
        return True

    # ------------------------------------------------------------------------------------------------------- reading
    def _by_key(self, key: str, **measures: str) -> DataFrame:
        """(key, one column a measure); a key that none of the measures has is missing."""
        rows = self.table.read().filter(F.col("measure").isin(list(measures.values())))
        return rows.groupBy(F.col("key").alias(key)).agg(*[F.sum(F.when(F.col("measure") == m, F.col("value"))).alias(n)
                                                           for n, m in measures.items()])

    def _totals(self, *names: str, **sets: str) -> DataFrame:
        """One row of totals, and of the sizes of sets."""
        rows = self.table.read().filter(F.col("measure").isin([*names, *sets.values()]))
        whole = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("value"))), F.lit(0))
        return rows.agg(*[whole(n).cast("double" if n == "completeness" else "long").alias(n) for n in names],
                        *[F.count_if(F.col("measure") == m).alias(n) for n, m in sets.items()])

    def kpi_totals(self) -> DataFrame:
        """Q1"""
        t = self._totals("records", "canonical", "mapped", "duplicates", "functional", "vetoes", "approved", "rejected", "pending",
                         "insufficient", "unclassified", "uom_issues", "abbreviations", "audit_events", "completeness",
                         "completeness_rows", orgs="org")
        return t.withColumns({
            "completeness": half_up(F.try_divide("completeness", "completeness_rows")),
            "code_reduction": F.when(F.col("mapped") > 0, 1 - F.col("canonical") / F.col("mapped")).otherwise(0.0)}).drop("completeness_rows")

    def category_breakdown(self) -> DataFrame:
        """Q2"""
        b = self._by_key("category", records="family_records", mapped="family_mapped", canonical="family_canonical",
                         pending="family_pending", duplicates="family_duplicates").filter("records is not null")
        long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        b = b.select("category", *[long(c).alias(c) for c in ("records", "mapped", "canonical", "pending", "duplicates")])
        return b.withColumns({"remaining": F.greatest(F.lit(0), F.col("records") - F.col("mapped")), "pct_mapped": F.coalesce(
            half_up(F.try_divide(F.col("mapped"), F.col("records"))), F.lit(0.0))})

    def match_type_histogram(self) -> DataFrame:
        """Q3"""
        place = F.array_position(F.array(*[F.lit(t) for t in MATCH_TYPE_ORDER]), F.col("match_type"))
        return self._by_key("match_type", n="match_type").select("match_type", F.col("n").cast("long").alias("n"), place.cast("int").alias("ordinal"))

    def org_scorecard(self, orgs: DataFrame) -> DataFrame:
        """Q4 - organisations without records included."""
        b = self._by_key("org", records="org_records", mapped="org_mapped", pending="org_pending", uom_issues="org_uom_issues",
                         c="org_completeness", c_rows="org_completeness_rows")
        long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return orgs.select("org").join(b, "org", "left").select(
            "org", long("records"), long("mapped"), long("pending"), F.coalesce(half_up(F.try_divide(
                F.col("c").cast("double"), F.col("c_rows").cast("double"))), F.lit(0.0)).alias("completeness"), long("uom_issues"))

    def decision_timeline(self, as_of: str, days: int = 30) -> DataFrame:
        """Q5"""
        last = F.to_date(F.lit(as_of))
        calendar = self.spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")).select(
            F.date_format("day", "yyyy-MM-dd").alias("day"))
        daily = self._by_key("day", approved="day_approved", rejected="day_rejected")
        long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return calendar.join(daily, "day", "left").select("day", long("approved"), long("rejected"))

    def flag_histogram(self) -> DataFrame:
        """Q6"""
        return self._by_key("flag", n="flag").withColumn("n", F.col("n").cast("long"))

    def funnel(self) -> DataFrame:
        """Q7"""
        return self._totals("records", "normalized", "classified", "mapped", matched="matched").select(
            F.col("records").alias("ingested"), "normalized", "classified", "matched", F.col("mapped").alias("harmonised"))

    def opportunities(self, min_orgs: int = 3) -> DataFrame:
        """Q8, Q9"""
        rows = self.table.read()
        sums = self._by_key("cnmc", codes="codes", qty="qty", spend="spend")
        orgs = rows.filter("measure = 'code_org'").groupBy(F.col("key").alias("cnmc")).agg(
            F.count("member").alias("orgs"), F.array_join(F.sort_array(F.collect_list("member")), ",").alias("org_codes"))
        price = F.col("member").cast("double")
        prices = rows.filter("measure = 'code_price'").groupBy(F.col("key").alias("cnmc")).agg(
            F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.sum("value").cast("long").alias("price_points"))
        live = rows.filter("measure = 'code_family'").select(F.col("key").alias("cnmc"), F.col("member").alias("category"))
        rate = F.when(F.col("orgs") >= 5, 0.12).when(F.col("orgs") == 4, 0.1).otherwise(0.08)
        return live.join(orgs.filter(F.col("orgs") >= min_orgs), "cnmc").join(sums, "cnmc").join(prices, "cnmc", "left").select(
            "cnmc", "category", "orgs", F.col("codes").cast("long").alias("codes"), "org_codes",
            F.coalesce(F.col("spend").cast("double"), F.lit(0.0)).alias("spend"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"),
            "min_price", "max_price", F.coalesce("price_points", F.lit(0)).alias("price_points")).withColumns({
                "est_saving": F.col("spend") * rate, "price_spread": F.when((F.col("min_price") != 0) & (F.col("max_price") != 0),
                                                                            (F.col("max_price") - F.col("min_price")) / F.col("min_price"))})
