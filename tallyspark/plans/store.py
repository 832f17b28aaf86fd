"""Entity store queries: changes, searches, exports and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.entity_store import EntityStore
from tallyspark.plans.registry import query
from tallyspark.plans.roles import GRAPH, documents_store, graph, table
from tallyspark.session import work_dir

_STORE = f"WITH {GRAPH}"
# The store in one long form, so that a result covers entities, observations and relations alike.
_LONG = """SELECT 'entity' AS part, name AS a, entity_type AS b, CAST(NULL AS VARCHAR) AS c FROM {e}
  UNION ALL SELECT 'observation', entity, observation, NULL FROM {o}
  UNION ALL SELECT 'relation', src, dst, relation_type FROM {r}"""


def long_form(store: EntityStore) -> DataFrame:
    def part(label: str, df: DataFrame, a: str, b: str, c: str | None = None) -> DataFrame:
        third = F.col(c) if c else F.lit(None).cast("string")
        return df.select(F.lit(label).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"), third.alias("c"))

    return (
        part("entity", store.entities, "name", "entity_type")
        .unionByName(part("observation", store.observations, "entity", "observation"))
        .unionByName(part("relation", store.relations, "src", "dst", "relation_type"))
    )


# -- changes -----------------------------------------------------------------------------------


def _indebted(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with a negative balance."""
    return table(spark, folder, "supplier").filter(F.col("s_acctbal") < 0)


@query(
    f"""{_STORE}, changed AS (SELECT s_name FROM supplier WHERE s_acctbal < 0),
        e AS (SELECT name, CASE WHEN entity_type = 'supplier' AND name IN (SELECT s_name FROM changed)
                                THEN 'debtor' ELSE entity_type END AS entity_type FROM entities
              UNION ALL SELECT 'Part ' || p_brand, 'brand' FROM (SELECT DISTINCT p_brand FROM part)),
        o AS (SELECT * FROM observations WHERE entity NOT IN (SELECT s_name FROM changed)
              UNION ALL SELECT s_name, 'in debt' FROM changed)
        {_LONG.format(e='e', o='o', r='relations')}"""
)
def kg_upsert_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Indebted suppliers change type (twice, the later entry wins); brands are new."""
    debtors = _indebted(spark, folder)
    steps = F.posexplode(F.array(F.lit("watched"), F.lit("debtor"))).alias("seq", "entity_type")
    changed = debtors.select(F.col("s_name").alias("name"), steps).select(
        "seq", "name", "entity_type", F.array(F.lit("in debt")).alias("observations")
    )
    brands = table(spark, folder, "part").select(
        F.lit(1).alias("seq"),
        F.concat(F.lit("Part "), "p_brand").alias("name"),
        F.lit("brand").alias("entity_type"),
        F.array().cast("array<string>").alias("observations"),
    )
    return long_form(graph(spark, folder).upsert_entities(changed.unionByName(brands)))


@query(
    f"""{_STORE}, r AS (SELECT * FROM relations
          UNION SELECT DISTINCT c_name, s_name, 'buys_from' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        SELECT src, dst, relation_type FROM r"""
)
def kg_add_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Who buys full loads from whom; existing relations are sent again and stay single."""
    loads = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    pairs = loads.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    buyers = table(spark, folder, "customer").select("c_custkey", "c_name")
    sellers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    named = pairs.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(
        sellers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    batch = named.select(F.col("c_name").alias("src"), F.col("s_name").alias("dst"), F.lit("buys_from").alias("relation_type"))
    store = graph(spark, folder)
    return store.add_relations(batch.unionByName(store.relations)).relations


@query(
    f"""{_STORE}, batch AS (
          SELECT c_name AS src, 'Segment ' || c_mktsegment AS dst, 'in_segment' AS relation_type FROM customer
          UNION ALL SELECT n_name, r_name, 'in_region' FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT src, dst, relation_type, dst AS missing_endpoint FROM batch
        WHERE dst NOT IN (SELECT name FROM entities)"""
)
def kg_dangling_relations(spark: SparkSession, folder: str) -> DataFrame:
    store = graph(spark, folder)
    batch = table(spark, folder, "customer").select(
        F.col("c_name").alias("src"),
        F.concat(F.lit("Segment "), "c_mktsegment").alias("dst"),
        F.lit("in_segment").alias("relation_type"),
    )
    return store.dangling_relations(batch.unionByName(store.relations.filter(F.col("relation_type") == "in_region")))


@query(
    f"""{_STORE} SELECT entity, observation FROM observations
        UNION SELECT c_name, 'segment ' || c_mktsegment FROM customer
        UNION SELECT s_name, p_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
              JOIN part ON l_partkey = p_partkey"""
)
def kg_add_observations(spark: SparkSession, folder: str) -> DataFrame:
    """A segment note per customer; observations already known are sent again and stay single."""
    store = graph(spark, folder)
    notes = table(spark, folder, "customer").select(
        F.col("c_name").alias("entity"), F.concat(F.lit("segment "), "c_mktsegment").alias("observation")
    )
    return store.add_observations(notes.unionByName(store.observations)).observations


@query(
    f"""{_STORE} SELECT entity, observation FROM observations
        WHERE entity NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)
        UNION ALL SELECT s_name, 'balance below zero' FROM supplier WHERE s_acctbal < 0"""
)
def kg_overwrite_observations(spark: SparkSession, folder: str) -> DataFrame:
    batch = _indebted(spark, folder).select(
        F.col("s_name").alias("entity"), F.lit("balance below zero").alias("observation")
    )
    return graph(spark, folder).overwrite_observations(batch).observations


@query(
    f"""{_STORE}, gone AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'NOWHERE'),
        e AS (SELECT * FROM entities WHERE name NOT IN (SELECT name FROM gone)),
        o AS (SELECT * FROM observations WHERE entity NOT IN (SELECT name FROM gone)),
        r AS (SELECT * FROM relations WHERE src NOT IN (SELECT name FROM gone) AND dst NOT IN (SELECT name FROM gone))
        {_LONG.format(e='e', o='o', r='r')}"""
)
def kg_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Delete the nations of one region, and a name the store does not know."""
    nations = table(spark, folder, "nation").filter(F.col("n_regionkey") == 0)
    names = nations.select(F.explode(F.array(F.col("n_name"), F.lit("NOWHERE"))).alias("name"))
    return long_form(graph(spark, folder).delete_entities(names))


@query(
    f"""{_STORE} SELECT src, dst, relation_type FROM relations
        EXCEPT SELECT s_name, n_name, 'located_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0"""
)
def kg_delete_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Indebted suppliers lose their location; the same pairs under another type are unknown and ignored."""
    nation = table(spark, folder, "nation")
    kinds = F.explode(F.array(F.lit("located_in"), F.lit("lives_in"))).alias("relation_type")
    batch = (
        _indebted(spark, folder)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), kinds)
    )
    return graph(spark, folder).delete_relations(batch).relations


# -- searches ----------------------------------------------------------------------------------

# Every searchable text of every entity; a document's lines are its observations.
_TEXTS = f"""{_STORE}, fields AS (
  SELECT name, LOWER(name) AS t FROM entities UNION ALL SELECT name, LOWER(entity_type) FROM entities
  UNION ALL SELECT entity, LOWER(observation) FROM observations
  UNION ALL SELECT 'doc_' || doc_id, 'doc_' || doc_id FROM documents
  UNION ALL SELECT 'doc_' || doc_id, LOWER(lang) FROM documents
  UNION ALL SELECT 'doc_' || doc_id, LOWER(text) FROM documents),
kinds AS (SELECT name, entity_type FROM entities UNION ALL SELECT 'doc_' || doc_id, lang FROM documents)"""


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (
          SELECT name FROM fields WHERE CONTAINS(t, 'economy') OR CONTAINS(t, 'license'))"""
)
def kg_search_any(spark: SparkSession, folder: str) -> DataFrame:
    return documents_store(spark, folder).search("  Economy LICENSE ", "any_token").entities


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (
          SELECT name FROM fields GROUP BY name HAVING BOOL_OR(CONTAINS(t, 'economy')) AND BOOL_OR(CONTAINS(t, 'supplier')))"""
)
def kg_search_all(spark: SparkSession, folder: str) -> DataFrame:
    return documents_store(spark, folder).search("economy Supplier", "all_tokens").entities


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (SELECT name FROM fields WHERE CONTAINS(t, 'on the'))"""
)
def kg_search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return documents_store(spark, folder).search("On the", "exact_phrase").entities


def _indexed(spark: SparkSession, folder: str) -> EntityStore:
    path = work_dir(spark, "indexed-store")
    documents_store(spark, folder).save(path, index=True)
    return EntityStore.load(spark, path)


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (
          SELECT name FROM fields WHERE CONTAINS(t, 'economy') OR CONTAINS(t, 'license') OR CONTAINS(t, 'ó'))"""
)
def kg_index_search_any(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the texts, asked for two words and a single letter."""
    return _indexed(spark, folder).search("economy LICENSE ó", "any_token").entities


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (
          SELECT name FROM fields GROUP BY name HAVING BOOL_OR(CONTAINS(t, 'economy')) AND BOOL_OR(CONTAINS(t, 'supplier')))"""
)
def kg_index_search_all(spark: SparkSession, folder: str) -> DataFrame:
    return _indexed(spark, folder).search("economy Supplier", "all_tokens").entities


@query(
    f"""{_TEXTS} SELECT name, entity_type FROM kinds WHERE name IN (SELECT name FROM fields WHERE CONTAINS(t, 'on the'))"""
)
def kg_index_search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _indexed(spark, folder).search("On the", "exact_phrase").entities


@query(
    f"""{_STORE}, hits AS (
          SELECT name FROM entities WHERE CONTAINS(LOWER(name), 'supplier') OR CONTAINS(LOWER(entity_type), 'supplier')
             OR CONTAINS(LOWER(name), 'nation_1') OR CONTAINS(LOWER(entity_type), 'nation_1')
          UNION SELECT entity FROM observations WHERE CONTAINS(LOWER(observation), 'supplier')
             OR CONTAINS(LOWER(observation), 'nation_1'))
        SELECT src, dst, relation_type FROM relations
        WHERE src IN (SELECT name FROM hits) AND dst IN (SELECT name FROM hits)"""
)
def kg_search_relations(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).search("supplier nation_1").relations


@query(
    f"""{_STORE}, wanted AS (SELECT s_name AS name FROM supplier WHERE s_acctbal < 0
                             UNION SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT 'NOWHERE'),
        e AS (SELECT * FROM entities WHERE name IN (SELECT name FROM wanted)),
        o AS (SELECT * FROM observations WHERE entity IN (SELECT name FROM wanted)),
        r AS (SELECT * FROM relations WHERE src IN (SELECT name FROM wanted) AND dst IN (SELECT name FROM wanted))
        {_LONG.format(e='e', o='o', r='r')}"""
)
def kg_open_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Indebted suppliers, the nations of one region and an unknown name."""
    nations = table(spark, folder, "nation").filter(F.col("n_regionkey") == 1)
    names = _indebted(spark, folder).select(F.col("s_name").alias("name"))
    names = names.unionByName(nations.select(F.explode(F.array(F.col("n_name"), F.lit("NOWHERE"))).alias("name")))
    return long_form(graph(spark, folder).open_nodes(names))


# -- size, export, storage ---------------------------------------------------------------------


def _quoted(column: str) -> str:
    return f"LENGTH(CAST(TO_JSON({column}) AS VARCHAR))"


@query(
    f"""{_STORE}, noted AS (SELECT entity, SUM({_quoted('observation')}) + COUNT(*) - 1 AS c FROM observations GROUP BY entity),
        e AS (SELECT COUNT(*) AS n, SUM(2 * {_quoted('name')} + {_quoted('entity_type')}
                + LENGTH(':{{"name":,"entity_type":,"observations":[]}}') + COALESCE(c, 0)) AS c
              FROM entities LEFT JOIN noted ON name = entity),
        r AS (SELECT COUNT(*) AS n, SUM({_quoted("src || ',' || dst || ',' || relation_type")} + {_quoted('src')} + {_quoted('dst')}
                + {_quoted('relation_type')} + LENGTH(':{{"relation_from":,"relation_to":,"relation_type":}}')) AS c FROM relations),
        size AS (SELECT CAST(e.c + e.n - 1 + r.c + r.n - 1 + LENGTH('{{"entities":{{}},"relations":{{}}}}') AS BIGINT) AS json_chars FROM e, r)
        SELECT json_chars, ROUND(json_chars * CAST(1.3 AS DOUBLE), 1) AS tokens,
               CASE WHEN json_chars * 1.3 <= 25000 THEN 'small' WHEN json_chars * 1.3 <= 50000 THEN 'medium' ELSE 'large' END
                 AS size_class FROM size"""
)
def kg_size_class(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).size()


@query(
    f"""{_STORE} SELECT (SELECT COUNT(*) FROM entities) AS entities, (SELECT COUNT(*) FROM relations) AS relations,
        (SELECT COUNT(*) FROM observations) AS observations"""
)
def kg_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).stats()


_NUMBERED = f"""{_STORE}, numbered AS (
  SELECT entity, observation, entity || '__obs_' || CAST(ROW_NUMBER() OVER (
    PARTITION BY entity ORDER BY SUBSTR(MD5(observation), 1, 3), observation) - 1 AS VARCHAR) AS node_id
  FROM observations)"""


@query(
    f"""{_NUMBERED} SELECT name AS node_id, 'entity' AS node_type, entity_type AS label FROM entities
        UNION ALL SELECT node_id, 'observation', observation FROM numbered"""
)
def kg_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).nodes()


@query(
    f"""{_NUMBERED} SELECT entity AS src, node_id AS dst, 'has_observation' AS edge_type, CAST(NULL AS VARCHAR) AS relation_type
        FROM numbered UNION ALL SELECT src, dst, 'relation', relation_type FROM relations"""
)
def kg_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).edges()


@query(f"{_STORE} {_LONG.format(e='entities', o='observations', r='relations')}")
def kg_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "store")
    graph(spark, folder).save(path)
    return long_form(EntityStore.load(spark, path))
