"""From the raw CSV tables to the offers, stage by stage.

Every stage writes its result tables as Parquet under one folder and then its
manifest: for each table the columns and their types, the rows and a hash of
them, and the state of what the stage read. A stage whose manifest still
describes what is there is not run again, so a flow that was interrupted goes
on where it stopped, and a change of the input or of a parameter runs again
what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import cluster as C
from ..operators import features as FE
from ..operators import offers as G
from ..operators import prep as P
from ..operators import profile as PR
from ..sources import io as IO
from ..sources.tables import path_state, remove_folder
from . import segmentation as SEG


@dataclass
class Settings:
    """What the flow may be told; the defaults are the source project's."""
    clusters: int = 5
    k_values: tuple = tuple(range(2, 11))
    starts: int = 50
    seed: int = 42
    scaling: str = "robust"
    min_support: float = 0.01
    min_confidence: float = 0.15
    min_lift: float = 1.2
    rules_per_cluster: int = 20
    products_per_cluster: int = 10
    profile_columns: list = field(default_factory=lambda: ["age", "customer_tenure", "total_lifetime_spend", "lifetime_total_distinct_products",
                                                           "percentage_of_products_bought_promotion", "number_complaints", "distinct_stores_visited",
                                                           "has_loyalty_card", "total_children_home", "typical_hour"])


class Flow:
    """The stages over one pair of CSV files, one offer plan and one result folder."""

    def __init__(self, spark: SparkSession, customers: str, baskets: str, plan: DataFrame, folder: str, settings: Settings | None = None):
        self.spark, self.customers, self.baskets, self.plan = spark, customers, baskets, plan
        self.folder, self.settings = folder.rstrip("/"), settings or Settings()
        self.ran: list[str] = []

    # -------------------------------------------------------------- manifest
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def manifest(self, stage: str) -> dict | None:
        """The manifest of a stage, or None where it has not ended."""
        path = f"{self.folder}/_manifest/{stage}"
        if not path_state(self.spark, path):
            return None
        return json.loads(self.spark.read.text(path).first()["value"])

    def _described(self, name: str) -> dict:
        df = self.table(name)
        rows, content = IO.content(df)
        return {"columns": df.schema.simpleString(), "rows": rows, "hash": str(content)}

    def _intact(self, found: dict | None, needs: str) -> bool:
        """Whether the tables are those that the manifest describes, made from the same input."""
        if not found or found["needs"] != needs:
            return False
        return all(path_state(self.spark, f"{self.folder}/{name}") and self._described(name) == kept for name, kept in found["tables"].items())

    def _stage(self, name: str, needs, build) -> None:
        """Run ``build()`` = {table: (DataFrame, rows it must have or None)} unless its results are there.

        A function instead of a DataFrame is called once the tables before it have been written."""
        needs = hashlib.sha256(json.dumps([name, needs, repr(self.settings)], default=str).encode()).hexdigest()
        if self._intact(self.manifest(name), needs):
            return
        remove_folder(self.spark, f"{self.folder}/_manifest/{name}")
        tables = {}
        for table, (df, rows) in build().items():
            IO.write_table(df() if callable(df) else df, f"{self.folder}/{table}")
            tables[table] = self._described(table)
            if rows is not None and tables[table]["rows"] != rows:
                raise ValueError(f"{table} has {tables[table]['rows']} rows instead of {rows}")
        text = json.dumps({"stage": name, "needs": needs, "tables": tables})
        # the manifest is written last: a stage without one has not ended
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_manifest/{name}")
        self.ran.append(name)

    def _made_by(self, *stages: str) -> list:
        return [self.manifest(s)["tables"] for s in stages]

    # -------------------------------------------------------------- stages
    def run(self) -> dict[str, DataFrame]:
        """All stages in order; {table: DataFrame} of all results."""
        for stage in (self.features, self.scaled, self.segments, self.profiles, self.basket_tables, self.rules, self.offers):
            stage()
        names = [n for s in ("features", "scaled", "segments", "profiles", "baskets", "rules", "offers") for n in self.manifest(s)["tables"]]
        return {n: self.table(n) for n in names}

    def features(self) -> None:
        def build():
            raw = IO.read_customer_info(self.spark, self.customers)
            feats = FE.add_customer_info_features(raw)
            gone = FE.removed_columns(raw, feats)
            return {"customer_features": (feats, raw.count()),
                    "removed_columns": (self.spark.createDataFrame([(c,) for c in gone], "column string"), None)}

        self._stage("features", path_state(self.spark, self.customers), build)

    def _model_columns(self) -> list[str]:
        return SEG.model_columns(self.table("customer_features"))

    def scaled(self) -> None:
        def build():
            feats = self.table("customer_features")
            return {"scaled_features": (P.preprocess_for_clustering(feats, self._model_columns(), method=self.settings.scaling), feats.count())}

        self._stage("scaled", self._made_by("features"), build)

    def segments(self) -> None:
        def build():
            s, scaled = self.settings, self.table("scaled_features")
            cols = C.validate_clustering_input(scaled)
            metrics, models = SEG.k_sweep(scaled, cols, sorted({*s.k_values, s.clusters}), s.seed, s.starts)
            labels = next(m for m in models if len(m.centers) == s.clusters).assign(scaled).select("customer_id", "cluster")
            return {"customer_clusters": (labels, scaled.count()), "kmeans_metrics": (SEG.metric_rows(self.spark, metrics), None)}

        self._stage("segments", self._made_by("scaled"), build)

    def profiles(self) -> None:
        def build():
            labels, feats = self.table("customer_clusters"), self.table("customer_features")
            known = PR.profile_input(labels, feats)
            shares = [c for c in feats.columns if c.startswith(FE.SHARE_PREFIX)]
            n = labels.select("cluster").distinct().count()
            return {"cluster_profile_summary": (PR.create_cluster_profile(known, "cluster", self.settings.profile_columns), n),
                    "cluster_spending_shares": (PR.mean_profile(known, "cluster", shares), n),
                    "cluster_metric_means": (PR.metric_means(known, "cluster"), n)}

        self._stage("profiles", self._made_by("features", "segments"), build)

    def basket_tables(self) -> None:
        def build():
            labels = self.table("customer_clusters")
            B.validate_customer_clusters(labels)
            parsed = IO.read_customer_basket(self.spark, self.baskets)
            n = labels.select("cluster").distinct().count()

            def profile():
                items = self.table("basket_items")
                return B.cluster_basket_profile(B.baskets_of(items), items, labels)

            return {"basket_items": (B.basket_items(B.explode_items(parsed), parsed, labels), None), "cluster_basket_profile": (profile, n),
                    "cluster_top_products": (lambda: B.cluster_top_products(self.table("basket_items"), self.settings.products_per_cluster, count_col="n"), None)}

        self._stage("baskets", [self._made_by("segments"), path_state(self.spark, self.baskets)], build)

    def rules(self) -> None:
        def build():
            s, items = self.settings, self.table("basket_items")
            found = B.cluster_association_rules_from_sets(B.item_sets_of(items), "cluster", min_support=s.min_support, min_confidence=s.min_confidence,
                                                          min_lift=s.min_lift, top_n=s.rules_per_cluster, few=B.few_groups(self.table("customer_clusters")))
            return {"cluster_association_rules": (found, None),
                    "cluster_rule_summary": (lambda: B.rule_summary(self.table("cluster_association_rules")), None),
                    "cluster_top_rules": (lambda: B.top_rules_with_label(self.table("cluster_association_rules")), None)}

        self._stage("rules", self._made_by("baskets"), build)

    def offers(self) -> None:
        def build():
            shares = [(c.removeprefix(FE.SHARE_PREFIX), c) for c in self.table("cluster_spending_shares").columns if c != "cluster"]
            out = G.create_cluster_promotion_recommendations(
                self.plan, self.table("cluster_profile_summary"), self.table("cluster_spending_shares"), self.table("cluster_basket_profile"),
                self.table("cluster_top_products"), self.table("cluster_association_rules"), shares)
            return {"cluster_promotion_recommendations": (out, self.plan.count())}

        self._stage("offers", [self._made_by("profiles", "baskets", "rules"), str(IO.content(self.plan))], build)
