"""The search engine: queries and profiles to ranked contracts, every method a lazy DataFrame.

Texts become vectors, and addresses points, by functions that are passed in, as no model or geocoder comes with this
package: ``embed`` maps (key, item) rows to (key, embedding), ``locate`` maps (key, address) rows to (key, lat, lon).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity

Hook = Callable[[DataFrame], DataFrame]


@dataclass
class SearchEngine:
    """``items``, ``entity_items``: (contract_id, embedding); ``places``: (contract_id, lat, lon)."""

    items: DataFrame
    places: DataFrame
    entity_items: DataFrame
    embed: Hook
    locate: Hook
    num_results: int = 1
    random_bias_rate: float = 0.0
    seed: int = 0

    def query_items(self, texts: DataFrame) -> DataFrame:
        """(query_id, text) to (query_id, embedding): a line of the text is an item, empty ones too."""
        lines = texts.select("query_id", F.posexplode(F.split("text", "\n")).alias("pos", "item"))
        return self.embed(lines)

    def query_by_subject(self, texts: DataFrame) -> DataFrame:
        return similarity.fused_top({"subject": (self.items, self.query_items(texts))}, self.num_results)

    def query_by_entity_subject(self, texts: DataFrame) -> DataFrame:
        return similarity.fused_top({"entity_subject": (self.entity_items, self.query_items(texts))}, self.num_results)

    def query_by_address(self, addresses: DataFrame) -> DataFrame:
        return similarity.top_by_place(self.places, self.locate(addresses), self.num_results)

    def query(self, subject: DataFrame | None = None, locality: DataFrame | None = None, entity_subject: DataFrame | None = None, isolate: bool = False) -> DataFrame:
        """Fusion of the components that are given. Texts of both kinds form one list that both item components score, unless ``isolate``."""
        texts = {"subject": subject, "entity_subject": entity_subject}
        own = {name: self.query_items(rows) for name, rows in texts.items() if rows is not None}
        if not isolate and len(own) == 2:
            both = own["subject"].unionByName(own["entity_subject"])
            own = dict.fromkeys(own, both)
        parts = {name: (self.items if name == "subject" else self.entity_items, rows) for name, rows in own.items()}
        if locality is not None:
            parts["locality"] = self.places, self.locate(locality)
        return self._ranked(parts)

    def query_by_user_profile(self, profile_items: DataFrame, profile_places: DataFrame, components: tuple[str, ...] = ("subject", "locality", "entity_subject")) -> DataFrame:
        """Recommendations for many profiles at once: (query_id, embedding) rows, a profile's cached items among them, and (query_id, pos, lat, lon)."""
        parts = {}
        if "subject" in components:
            parts["subject"] = self.items, profile_items
        if "locality" in components:
            parts["locality"] = self.places, similarity.first_places(profile_places)
        if "entity_subject" in components:
            parts["entity_subject"] = self.entity_items, profile_items
        return self._ranked(parts)

    def sections(self, profile_items: DataFrame, profile_places: DataFrame) -> dict[str, DataFrame]:
        """The four sections of a recommendation page."""
        kinds = {"all": ("subject", "locality", "entity_subject"), "subject": ("subject",), "locality": ("locality",), "entity_subject": ("entity_subject",)}
        return {name: self.query_by_user_profile(profile_items, profile_places, kind) for name, kind in kinds.items()}

    def _ranked(self, parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
        """A random bias changes every contract's similarity, so with one all pairs are scored."""
        if not self.random_bias_rate:
            return similarity.fused_top(parts, self.num_results)
        every = {name: similarity.by_place(*sides) if name == "locality" else similarity.by_items(*sides) for name, sides in parts.items()}
        return similarity.top(similarity.fused(every, bias=self.random_bias_rate, seed=self.seed), self.num_results)


def search_form(subject: str = "", locality: str = "", entity_subject: str = "") -> dict[str, str]:
    """A form's fields as a query; empty ones are left out."""
    return {k: v for k, v in (("subject", subject), ("locality", locality), ("entity_subject", entity_subject)) if v}


def search_forms(rows: DataFrame, key: str = "form") -> DataFrame:
    """(key, field, value): the fields of many forms, a column each beside the key; empty ones are left out."""
    fields = [F.struct(F.lit(name).alias("field"), F.col(name).alias("value")) for name in ("subject", "locality", "entity_subject")]
    return rows.select(key, F.inline(F.filter(F.array(*fields), lambda f: f["value"] != "")))


def hydrated(results: DataFrame, contracts: DataFrame) -> DataFrame:
    """Results with the details of their contracts, joined by id, in the order of rank; contracts that are missing drop out alone."""
    return results.join(contracts, "contract_id")


def in_given_order(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows with the given ids and their positions in the list."""
    spark = rows.sparkSession
    order = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"`{key}` long, position int")
    return rows.join(F.broadcast(order) if len(ids) <= 100_000 else order, key)


def displayed(rows: DataFrame, items_col: str, n: int = 5, chars: int = 30) -> DataFrame:
    """The first n items of a list, each cut to ``chars`` characters and three dots."""
    return rows.withColumn(items_col, F.transform(F.slice(items_col, 1, n), lambda x: F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars), F.lit("..."))).otherwise(x)))
