"""Batch jobs: from documents to classification codes and items, from lines to embeddings, from a registry to entities.

Each is one plan over all rows that are still to do, an anti-join away from those that are done; there are no batches.
Models and services are hooks, functions from rows to rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import contexts, relational, subjects

Hook = Callable[[DataFrame], DataFrame]


def merged(docs: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, text): the documents (key, doc_id, text) of a contract in order, each behind its header."""
    listed = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    return listed.select(key, T.merged_documents(F.col("docs")).alias("text"))


def to_do(docs: DataFrame, done: DataFrame, key: str = "contract_id") -> DataFrame:
    """Documents of contracts that have no row in ``done``."""
    return docs.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def contract_codes(docs: DataFrame, done: DataFrame, known: DataFrame, key: str = "contract_id") -> DataFrame:
    """(key, cpv_id): the known codes (id, code) that a contract's documents name, once each.

    Codes are found document by document, so no contract's documents have to meet.
    """
    found = to_do(docs, done, key).select(key, F.explode(T.cpv_codes(F.col("text"))).alias("code")).distinct()
    return found.join(relational.enumeration(known), "code").select(key, F.col("id").alias("cpv_id"))


def contract_items(docs: DataFrame, done: DataFrame, embed: Hook, key: str = "contract_id", keywords: dict[str, float] = contexts.KEYWORDS, sentences: Hook | None = None) -> DataFrame:
    """(key, item, embedding) of the items in the subject contexts of contracts that have none yet."""
    text = merged(to_do(docs, done, key), key)
    found = subjects.extracted(text, contexts.contexts(text, keywords, key), key, sentences)
    return embed(found.select(key, F.explode(T.split_items(F.array("items"))).alias("item")))


def entity_embeddings(entities: DataFrame, embed: Hook, key: str = "entity_id", lines: str = "description") -> DataFrame:
    """(key, item, embedding): the lines of an entity's description that are not empty, embedded."""
    return embed(entities.select(key, F.explode(T.split_items(F.array(lines))).alias("item")))


def _named(name: str) -> str:
    """An XPath step for an element, with or without a prefix."""
    return f"*[name() = \"{name}\" or name() = \"D:{name}\"]"


#: A registry's address, in the order of its parts.
ADDRESS = ("N", "NCO", "NMC", "NU", "CD", "PSC")


def registry_subjects(xml: str) -> Column:
    """The distinct subjects of a registry's answer, sorted: what ``T`` says under each ``PP``, or ``PP`` itself; none, one or many."""
    under, alone = (f"xpath({xml}, '//{_named('PPI')}/{_named('PP')}{rest}/text()')" for rest in (f"/{_named('T')}", f"[not({_named('T')})]"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.expr(f"concat({under}, {alone})"), lambda x: T.stripped(x)), lambda x: x != "")))


def registry_address(xml: str) -> Column:
    """The parts of an address, joined by commas; missing ones are empty; null if the answer has no address."""
    parts = [F.expr(f"xpath_string({xml}, '//{_named('AA')}/{_named(name)}')") for name in ADDRESS]
    return F.when(F.expr(f"xpath_boolean({xml}, '//{_named('AA')}')"), T.address_of(*parts))


def registry_enriched(entities: DataFrame, ask: Hook, locate: Hook, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """(entities with their coordinates, (key, subject) rows to append) for entities that have no coordinates.

    ``ask`` maps (key, ico) to (key, xml), ``locate`` (key, address) to (key, lat, lon).
    """
    answers = ask(entities.where("lat is null or lon is null").select(key, "ico")).withColumn("xml", T.plain_namespaces(F.col("xml")))
    addresses = answers.select(key, registry_address("xml").alias("address")).where("address is not null")
    placed = relational.updated(entities, locate(addresses), key, ["lat", "lon"])
    return placed, answers.select(key, F.explode(registry_subjects("xml")).alias("subject"))


def imported_codes(rows: DataFrame, embed: Hook) -> DataFrame:
    """(id, code, name, parent_id, embedding) of a code list, its names embedded."""
    return rows.join(embed(rows.select("id", F.col("name").alias("item"))).select("id", "embedding"), "id")


# Profiles


def profiles(stored: DataFrame, registry: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, origin, lat, lon, items) of the users asked for: an id of eight characters is an entity's registry
    number, any other one a stored profile's. Both sides: (user_id, lat, lon, items)."""
    asked = users.select(F.trim(F.col("user_id")).alias("user_id")).distinct()
    by_number, by_id = asked.where("length(user_id) = 8"), asked.where("length(user_id) <> 8")
    side = lambda rows, ids, origin: rows.withColumn("user_id", F.trim(F.col("user_id").cast("string"))).join(ids, "user_id", "left_semi").select("user_id", F.lit(origin).alias("origin"), "lat", "lon", "items")
    return side(registry, by_number, "registry").unionByName(side(stored, by_id, "profile"))


def edited(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles (user_id, lat, lon, items, cache) with those of ``edits`` (user_id, lat, lon, items) replaced, their caches emptied."""
    same = profiles.join(edits.select("user_id"), "user_id", "left_anti")
    fresh = edits.select("user_id", "lat", "lon", "items", F.array().cast("array<string>").alias("cache"))
    return same.select("user_id", "lat", "lon", "items", "cache").unionByName(fresh)


def made_profiles(rows: DataFrame, embed: Hook, locate: Hook) -> DataFrame:
    """(user_id, lat, lon, items, embeddings) from (user_id, address, items), with equal places in both arrays."""
    each = embed(rows.select("user_id", F.posexplode("items").alias("pos", "item")))
    listed = each.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "embedding"))).alias("all"))
    places = locate(rows.select("user_id", "address"))
    return rows.select("user_id").join(places, "user_id", "left").join(listed.select("user_id", F.col("all.item").alias("items"), F.col("all.embedding").alias("embeddings")), "user_id", "left")
