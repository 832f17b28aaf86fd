"""Entities, their observations and the relations between them.

Three DataFrames hold the store in long form; every change returns a new store and leaves the old
one alone. Batches of changes are DataFrames too, so they may be as large as the store.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.safe import rounded
from tallyspark.operators.hot_keys import keep_known
from tallyspark.operators.text_index import WRITTEN, containing, postings
from tallyspark.sources import files
from tallyspark.sources.versioned import VersionedDataset

# Size classes by tokens, and tokens per JSON character.
SIZE_LIMITS = [("small", 25_000), ("medium", 50_000), ("large", 100_000)]
TOKENS_PER_CHARACTER = 1.3

TRIPLE = ["src", "dst", "relation_type"]
_ENTITIES = "name string, entity_type string"
_OBSERVATIONS = "entity string, observation string"
_RELATIONS = "src string, dst string, relation_type string"


@dataclass(frozen=True)
class EntityStore:
    """entities(name, entity_type), observations(entity, observation), relations(src, dst, relation_type)."""

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame
    #: Index of all texts, where the store was saved with one; changes of texts leave it behind.
    postings: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession) -> EntityStore:
        return EntityStore(*[spark.createDataFrame([], s) for s in (_ENTITIES, _OBSERVATIONS, _RELATIONS)])

    # -- changes ---------------------------------------------------------------------------

    def upsert_entities(self, batch: DataFrame) -> EntityStore:
        """Add or replace entities from (seq, name, entity_type, observations array).

        An existing entity of the same name loses its old type and observations; within the batch
        the highest ``seq`` of a name wins.
        """
        newest = W.partitionBy("name").orderBy(F.desc("seq"))
        final = batch.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1)
        names = final.select("name")
        added = final.select(F.col("name").alias("entity"), F.explode("observations").alias("observation")).distinct()
        return replace(
            self,
            entities=self.entities.join(names, "name", "left_anti").unionByName(final.select("name", "entity_type")),
            observations=self._drop_observations(names).unionByName(added),
            postings=None,
        )

    def _drop_observations(self, names: DataFrame) -> DataFrame:
        return keep_known(self.observations, "entity", names, "left_anti")

    def _unknown(self, names: DataFrame) -> DataFrame:
        """Distinct names that are no entity. A name used by very many rows is one row from here on."""
        return names.distinct().join(self.entities.select("name"), "name", "left_anti")

    def _unknown_endpoints(self, batch: DataFrame) -> DataFrame:
        return self._unknown(batch.select(F.explode(F.array("src", "dst")).alias("name")))

    def dangling_relations(self, batch: DataFrame) -> DataFrame:
        """(src, dst, relation_type, missing_endpoint) for every endpoint that is no entity."""
        ends = F.explode(F.array_distinct(F.array("src", "dst"))).alias("missing_endpoint")
        sides = batch.select(*TRIPLE).distinct().select(*TRIPLE, ends)
        missing = self._unknown_endpoints(batch).withColumnRenamed("name", "missing_endpoint")
        return keep_known(sides, "missing_endpoint", missing, name="missing_endpoint")

    def add_relations(self, batch: DataFrame) -> EntityStore:
        """Add relations, each triple once; a missing endpoint rejects the whole batch."""
        missing = self._unknown_endpoints(batch).head(1)
        if missing:
            raise ValueError(f"Entity '{missing[0]['name']}' not found in graph")
        return replace(self, relations=self.relations.unionByName(batch.select(*TRIPLE)).distinct())

    def add_observations(self, batch: DataFrame) -> EntityStore:
        """Union (entity, observation) rows into the store; an unknown entity rejects the batch."""
        unknown = self._unknown(batch.select(F.col("entity").alias("name"))).head(1)
        if unknown:
            raise ValueError(f"Entity {unknown[0]['name']} not found in graph")
        added = self.observations.unionByName(batch.select("entity", "observation")).distinct()
        return replace(self, observations=added, postings=None)

    def overwrite_observations(self, batch: DataFrame) -> EntityStore:
        """Replace all observations of the entities in (entity, observation) rows."""
        names = batch.select(F.col("entity").alias("name")).distinct()
        kept = self._drop_observations(names)
        return replace(self, observations=kept.unionByName(batch.select("entity", "observation").distinct()), postings=None)

    def delete_entities(self, names: DataFrame) -> EntityStore:
        """Drop entities with their observations and every relation touching them."""
        gone = names.select("name").distinct()
        left = keep_known(self.relations, "src", gone, "left_anti")
        return EntityStore(
            self.entities.join(gone, "name", "left_anti"),
            self._drop_observations(gone),
            keep_known(left, "dst", gone, "left_anti"),
        )

    def delete_relations(self, batch: DataFrame) -> EntityStore:
        """Drop exact triples; unknown ones are ignored."""
        return replace(self, relations=self.relations.join(batch.select(*TRIPLE).distinct(), TRIPLE, "left_anti"))

    # -- reads -----------------------------------------------------------------------------

    def _texts(self) -> DataFrame:
        """(name, text): every searchable text of every entity, lower-cased."""
        fields = self.entities.select("name", F.explode(F.array("name", "entity_type")).alias("text"))
        noted = self.observations.select(F.col("entity").alias("name"), F.col("observation").alias("text"))
        return fields.unionByName(noted).select("name", F.lower("text").alias("text"))

    def matching_names(self, query: str, mode: str = "any_token") -> DataFrame:
        """Names of entities whose texts contain the query, ignoring case.

        ``any_token``: some word of the query in some text; ``all_tokens``: every word, each in
        some text; ``exact_phrase``: the whole query within one text. A blank query finds nothing.
        A store with an index reads postings, others all texts, once.
        """
        tokens = list(dict.fromkeys(query.lower().split()))
        text = F.col("text")
        if not tokens:
            return self.entities.select("name").limit(0)
        if self.postings is not None and mode in ("any_token", "all_tokens", "exact_phrase"):
            found = containing(self.postings, tokens if mode != "exact_phrase" else [query.strip().lower()])
            if mode != "all_tokens":
                return found.select("name").distinct()
            return found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(tokens)).select("name")
        if mode == "exact_phrase":
            return self._texts().filter(text.contains(query.strip().lower())).select("name").distinct()
        found = [text.contains(t) for t in tokens]
        some = reduce(Column.__or__, found)
        if mode == "any_token":
            return self._texts().filter(some).select("name").distinct()
        if mode == "all_tokens":
            hits = self._texts().filter(some).groupBy("name")
            flags = hits.agg(*[F.bool_or(f).alias(f"_t{i}") for i, f in enumerate(found)])
            return flags.filter(reduce(Column.__and__, [F.col(f"_t{i}") for i in range(len(tokens))])).select("name")
        raise ValueError(f"unknown search mode {mode!r}")

    def search(self, query: str, mode: str = "any_token") -> EntityStore:
        """The sub-store of matching entities and the relations among them."""
        return self.induced(self.matching_names(query, mode))

    def open_nodes(self, names: DataFrame) -> EntityStore:
        """The sub-store of the named entities; unknown names are ignored."""
        return self.induced(names.select("name").distinct())

    def induced(self, names: DataFrame) -> EntityStore:
        """Entities among ``names`` (distinct) with their observations, and relations with both ends among them.

        An end that holds a large share of all relations is dealt to many tasks.
        """
        return EntityStore(
            self.entities.join(names, "name", "left_semi"),
            keep_known(self.observations, "entity", names),
            keep_known(keep_known(self.relations, "src", names), "dst", names),
        )

    def stats(self) -> DataFrame:
        """Numbers of entities, relations and observations."""
        parts = [("entities", self.entities), ("relations", self.relations), ("observations", self.observations)]
        counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n") for part, df in parts]
        return reduce(DataFrame.unionByName, counts).agg(
            *[F.max(F.when(F.col("part") == part, F.col("n"))).alias(part) for part, _ in parts]
        )

    def size(self) -> DataFrame:
        """JSON characters of the store, tokens, and the size class they fall into.

        The characters are added up per row from the lengths of the escaped strings, so the
        document itself is never built.
        """

        def quoted(text: str) -> Column:
            return F.length(F.to_json(F.struct(F.col(text).alias("v")))) - len('{"v":}')

        entity = quoted("name") * 2 + quoted("entity_type") + len(':{"name":,"entity_type":,"observations":[]},')
        # Each observation adds its text and a comma; one comma per entity with observations is too many.
        per_entity = self.observations.groupBy("entity").agg(F.sum(quoted("observation") + 1).alias("c"))
        relation = (quoted("src") + quoted("dst") + quoted("relation_type")) * 2 - 4 + len(
            ',,:{"relation_from":,"relation_to":,"relation_type":},'
        )
        parts = [
            self.entities.agg(F.count(F.lit(1)).alias("n"), F.sum(entity).alias("c")).withColumn(
                "kind", F.lit("entity")
            ),
            per_entity.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") - 1).alias("c")).withColumn(
                "kind", F.lit("observation")
            ),
            self.relations.agg(F.count(F.lit(1)).alias("n"), F.sum(relation).alias("c")).withColumn(
                "kind", F.lit("relation")
            ),
        ]
        # Rows carry their separating comma; the last entity and the last relation have none.
        trailing = F.count_if(F.col("kind").isin("entity", "relation") & (F.col("n") > 0))
        characters = (F.sum(F.coalesce("c", F.lit(0))) - trailing + len('{"entities":{},"relations":{}}')).cast("long")
        entities = F.max(F.when(F.col("kind") == "entity", F.col("n")))
        sized = reduce(DataFrame.unionByName, parts).agg(entities.alias("entities"), characters.alias("json_chars"))
        tokens = F.col("json_chars") * TOKENS_PER_CHARACTER
        label = F.when(F.col("entities") == 0, "empty")
        for name, limit in SIZE_LIMITS:
            label = label.when(tokens <= limit, name)
        return sized.select("json_chars", rounded(tokens, 1).alias("tokens"), label.otherwise("large").alias("size_class"))

    # -- export ----------------------------------------------------------------------------

    def numbered_observations(self) -> DataFrame:
        """(entity, observation, i) with i running 0, 1, ... within each entity.

        The numbers follow the order of the text's MD5 digest. The digest prefix cuts an entity with
        very many observations into ranges that are numbered apart and then offset, so no task has
        to order all observations of one entity.
        """
        digest = F.md5(F.col("observation").cast("binary"))
        ranged = self.observations.withColumn("_range", F.substring(digest, 1, 3))
        counts = ranged.groupBy("entity", "_range").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(W.partitionBy("entity").orderBy("_range")) - F.col("_n")
        offsets = counts.select("entity", "_range", before.alias("_before"))  # 4096 ranges per entity at most
        place = F.row_number().over(W.partitionBy("entity", "_range").orderBy("observation")) - 1
        return (
            ranged.withColumn("_place", place)
            .join(offsets, ["entity", "_range"])
            .select("entity", "observation", (F.col("_before") + F.col("_place")).alias("i"))
        )

    def _observation_nodes(self) -> DataFrame:
        node = F.concat("entity", F.lit("__obs_"), F.col("i").cast("string"))
        return self.numbered_observations().select("entity", "observation", node.alias("node_id"))

    def nodes(self) -> DataFrame:
        """(node_id, node_type, label): entities by type and observations by text."""
        entities = self.entities.select(
            F.col("name").alias("node_id"), F.lit("entity").alias("node_type"), F.col("entity_type").alias("label")
        )
        observations = self._observation_nodes().select(
            "node_id", F.lit("observation").alias("node_type"), F.col("observation").alias("label")
        )
        return entities.unionByName(observations)

    def edges(self) -> DataFrame:
        """(src, dst, edge_type, relation_type): parallel relations between two entities are all kept."""
        observed = self._observation_nodes().select(
            F.col("entity").alias("src"),
            F.col("node_id").alias("dst"),
            F.lit("has_observation").alias("edge_type"),
            F.lit(None).cast("string").alias("relation_type"),
        )
        related = self.relations.select("src", "dst", F.lit("relation").alias("edge_type"), "relation_type")
        return observed.unionByName(related)

    # -- storage ---------------------------------------------------------------------------

    def save(self, path: str, index: bool = False) -> str:
        """Write a new version of the store under ``path``, with an index of its texts if wanted; earlier versions stay readable."""
        dataset = VersionedDataset(self.entities.sparkSession, path)
        parts = {"entities": self.entities, "observations": self.observations, "relations": self.relations}
        if not index:
            return dataset.write(parts)

        def indexed(version: str) -> DataFrame:
            """The texts just written, so that the store is not computed again."""
            return postings(EntityStore(*[dataset.read(version, part) for part in parts])._texts())

        return dataset.write(parts | {"postings": indexed}, options={p: {"compression": "zstd"} for p in parts} | {"postings": WRITTEN})

    @staticmethod
    def load(spark: SparkSession, path: str) -> EntityStore:
        """The latest complete version under ``path``; an empty store when nothing was saved yet.

        A version whose files cannot be read raises; it is never taken for an empty store.
        """
        dataset = VersionedDataset(spark, path)
        version = dataset.latest()
        if version is None:
            return EntityStore.empty(spark)
        parts = ["entities", "observations", "relations"]
        parts += ["postings"] if files.exists(spark, f"{path}/{version}/postings") else []
        return EntityStore(*[dataset.read(version, part) for part in parts])
