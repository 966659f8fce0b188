"""The compliance collections as views over the star-schema test tables.

Only the inputs are made to fit here; every operator runs on any frame with the
same columns.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complyframe.functions import scoring, text
from complyframe.functions.text import AMOUNT
from complyframe.operators import impact, reconcile
from complyframe.sources import storage
from complyframe.sources.tables import scan, stream_of_table


def _label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _once(view):
    """Build each view once per set of tables: the plan, not the data."""

    @wraps(view)
    def built(self, *args, **kwargs):
        key = (view.__name__, args, tuple(kwargs.items()))
        if key not in self._built:
            self._built[key] = view(self, *args, **kwargs)
        return self._built[key]

    return built


class Tables:
    """Lazy views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str, streams: tuple[str, ...] = (), few_substances: bool = False):
        self.spark, self.folder, self.streams, self.few_substances = spark, folder, streams, few_substances
        self._built: dict = {}

    @_once
    def table(self, name: str) -> DataFrame:
        """One table; as a file stream if it is named among ``streams``."""
        stored = scan(self.spark, f"{self.folder.rstrip('/')}/{name}.parquet")
        if name not in self.streams:
            return stored
        return stream_of_table(self.spark, self.folder, name, stored.schema)

    def streaming(self, *names: str) -> Tables:
        """The same tables with some of them read as streams."""
        return Tables(self.spark, self.folder, names, self.few_substances)

    @_once
    def market_jurisdictions(self) -> DataFrame:
        nation = self.table("nation")
        market = _label("market_", F.col("n_nationkey")).alias("market_id")
        both = F.array(_label("R", F.col("n_regionkey")), _label("N", F.col("n_nationkey")))
        return nation.select(market, F.explode(both).alias("jurisdiction"))

    @_once
    def markets(self) -> DataFrame:
        return self.table("nation").select(
            _label("market_", F.col("n_nationkey")).alias("id"),
            F.col("n_name").alias("country"),
            _label("C", F.col("n_nationkey")).alias("country_code"),
            F.array(_label("R", F.col("n_regionkey")), _label("N", F.col("n_nationkey"))).alias("jurisdictions"),
        )

    @_once
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("product_type"),
            _label("N", F.col("p_size") % 25).alias("origin"),
        )

    @_once
    def product_markets(self) -> DataFrame:
        key = F.col("p_partkey")
        targets = F.array(_label("market_", key % 25), _label("market_", (key + 7) % 25))
        return self.table("part").select(
            key.alias("product_id"), F.col("p_type").alias("product_type"), F.explode(targets).alias("market_id")
        )

    @_once
    def places(self) -> DataFrame:
        return impact.expand_markets(self.product_markets(), self.market_jurisdictions())

    @_once
    def substances(self) -> int:
        """How many substances there are: some 20, and more as products do, so that each meets a few clauses."""
        if self.few_substances:
            return 20
        return 20 + self.table("part").count() // 4

    @_once
    def ingredients(self) -> DataFrame:
        number = F.col("l_suppkey") % 20
        if not self.few_substances:
            number = (F.col("l_partkey") + number * 7) % self.substances()
        known = F.when(F.col("l_tax") != 0.0, F.col("l_discount").cast(AMOUNT))
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("product_id"), number.alias("_s"))
            .agg(F.max(known).alias("amount"))
            .select(
                "product_id",
                _label("sub_", F.col("_s")).alias("substance"),
                "amount",
                F.lit("percent_w_w").alias("unit"),
                text.in_base_unit(F.col("amount"), F.lit("percent_w_w")).alias("amount_base"),
            )
        )

    @_once
    def clauses(self) -> DataFrame:
        """All clauses in comparable form, with confidence."""
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        nations = self.table("nation").select("n_nationkey", "n_regionkey")
        joined = (
            self.table("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        )
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "*")
        limit = F.when(key % 3 == 0, (key % 11).cast("decimal(12,2)") * F.lit("0.01").cast("decimal(6,2)")).otherwise(
            (key % 11 * 100).cast("decimal(18,4)")
        )
        priority = F.col("o_orderpriority")
        rows = joined.select(
            key.alias("clause_id"),
            (key % 1000).alias("document_id"),
            _label("sub_", key % self.substances()).alias("substance"),
            F.when(key % 2 == 0, _label("N", F.col("n_nationkey")))
            .otherwise(_label("R", F.col("n_regionkey")))
            .alias("jurisdiction"),
            F.when(customer % 10 == 7, "documentation")
            .when(customer % 10 == 8, "labeling")
            .when(customer % 10 == 9, "certification")
            .otherwise("numeric_limit")
            .alias("clause_type"),
            F.get(F.array(*[F.lit(u) for u in ("percent_w_w", "mg_per_kg", "ppm")]), (key % 3).cast("int")).alias("unit"),
            limit.cast(AMOUNT).alias("limit_value"),
            F.get(F.array(*[F.lit(t) for t in types]), (key % 7).cast("int")).alias("product_type"),
            F.col("o_orderdate").cast("date").alias("effective_date"),
            F.date_add(F.col("o_orderdate").cast("date"), (customer % 30).cast("int")).alias("document_date"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "official_regulation")
            .when(priority == "3-MEDIUM", "industry_article")
            .otherwise("social")
            .alias("source_type"),
            F.when(F.col("o_orderstatus") == "F", "active")
            .when(F.col("o_orderstatus") == "O", "pending_reconciliation")
            .otherwise("superseded")
            .alias("status"),
            ((customer % 11).cast("decimal(6,2)") * F.lit("0.10").cast("decimal(6,2)")).cast(AMOUNT).alias("parse_quality"),
            ((key % 5).cast("decimal(6,2)") * F.lit("0.25").cast("decimal(6,2)")).cast(AMOUNT).alias("self_consistency"),
        )
        tier = scoring.authority_tier(F.col("source_type"))
        return reconcile.comparable_form(rows.withColumn("authority_tier", tier)).withColumn(
            "confidence",
            scoring.composite_confidence(F.col("parse_quality"), F.col("self_consistency"), F.col("authority_tier")),
        )

    @_once
    def stored_clauses(self) -> DataFrame:
        """The clause collection as a table, for work that passes over it several times."""
        return self._stored(self.clauses())

    def _stored(self, rows: DataFrame) -> DataFrame:
        """A written table has a known size, by which Spark picks broadcast or shuffle."""
        return storage.written(rows, storage.run_folder(self.spark))

    @_once
    def active(self) -> DataFrame:
        return self.clauses().where("status = 'active'")

    @_once
    def pending(self) -> DataFrame:
        return self.clauses().where("status = 'pending_reconciliation'")

    @_once
    def current(self) -> DataFrame:
        """Before the pending clauses arrive."""
        return self._stored(reconcile.current_clauses(self.active()))

    @_once
    def accepted(self) -> DataFrame:
        """Active clauses and the pending ones that pass the review gate."""
        live = reconcile.needs_review(self.clauses().where("status IN ('active', 'pending_reconciliation')"))
        return live.where("status = 'active' OR NOT gated")

    @_once
    def following(self) -> DataFrame:
        """Current clauses after the pending ones have arrived."""
        return self._stored(reconcile.current_clauses(self.accepted()))

    @_once
    def requirements(self, after: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
        clauses = self.following() if after else self.current()
        return impact.requirements(self.places(), self.ingredients(), clauses, only=only)

    @_once
    def status(self, after: bool = False) -> DataFrame:
        clauses = self.following() if after else self.current()
        return impact.product_status(self.places(), self.product_markets(), self.ingredients(), clauses)

    @_once
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            _label("prod_", F.col("user_id")).alias("entity_id"),
            "event_type",
            F.col("ts").alias("occurred_at"),
            "value",
            _label("trace_", F.col("event_id") % 500).alias("trace_id"),
            "props",
        )

    @_once
    def stage_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            (F.col("event_id") % 1000).alias("document_id"),
            F.when(kind == "signup", "uploaded")
            .when(kind == "view", "extracting")
            .when(kind == "click", "extracted")
            .when(kind == "purchase", "reconciled")
            .otherwise("failed")
            .alias("stage"),
            F.col("ts").alias("at"),
            F.col("event_id").alias("seq"),
        )

    @_once
    def limit_docs(self) -> DataFrame:
        doc = F.col("doc_id")
        names = F.array(*[F.lit(n) for n in ("sodium benzoate", "natrium benzoat", "E211", "unlisted extract")])
        units = F.array(*[F.lit(u) for u in (" mg/kg.", " ppm.", " grams per gallon.")])
        statement = F.concat(
            F.lit(" The maximum level of "),
            F.get(names, (doc % 4).cast("int")),
            F.lit(" is "),
            (doc % 900).cast("string"),
            F.get(units, (doc % 3).cast("int")),
        )
        return self.table("documents").select("doc_id", "source", F.concat("text", statement).alias("text"))

    @_once
    def documents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source", "n_chars")

    @_once
    def query_turns(self) -> DataFrame:
        turns = self.table("conversations")
        asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        answers = turns.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        return asked.join(answers, ["conv_id", "turn"])
