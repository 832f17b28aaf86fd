from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.entity_store import EntityStore
from tallyspark.operators.text_index import containing, postings
from tallyspark.session import work_dir
from tests.conftest import rows


def make(spark, entities, observations, relations) -> EntityStore:
    return EntityStore(
        spark.createDataFrame(entities, "name string, entity_type string"),
        spark.createDataFrame(observations, "entity string, observation string"),
        spark.createDataFrame(relations, "src string, dst string, relation_type string"),
    )


@pytest.fixture
def store(spark):
    return make(
        spark,
        [("Acme, Inc", "company"), ("Ann", "person"), ("Bob", "person"), ("Lonely", "task")],
        [("Ann", "likes Tea"), ("Ann", "works late"), ("Bob", "drinks coffee"), ("Acme, Inc", "makes tea cups")],
        [("Ann", "Acme, Inc", "works_at"), ("Ann", "Acme, Inc", "owns"), ("Bob", "Acme, Inc", "works_at"), ("Ann", "Bob", "knows")],
    )


def batch(spark, *data):
    return spark.createDataFrame(data, "seq int, name string, entity_type string, observations array<string>")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def triples(spark, *values):
    return spark.createDataFrame(values, "src string, dst string, relation_type string")


def test_upsert_replaces_and_last_wins(spark, store):
    after = store.upsert_entities(
        batch(spark, (1, "Ann", "boss", ["a"]), (2, "Ann", "owner", ["new", "new", "more"]), (1, "Zoe", "person", []))
    )
    assert ("Ann", "owner") in rows(after.entities) and ("Zoe", "person") in rows(after.entities)
    assert after.entities.count() == 5
    assert [o for e, o in rows(after.observations) if e == "Ann"] == ["more", "new"]
    assert after.relations.count() == 4 and ("Ann", "person") in rows(store.entities)


def test_relations_are_all_or_nothing(spark, store):
    with pytest.raises(ValueError, match="Nobody"):
        store.add_relations(triples(spark, ("Ann", "Lonely", "does"), ("Ann", "Nobody", "knows")))
    after = store.add_relations(triples(spark, ("Ann", "Lonely", "does"), ("Ann", "Bob", "knows"), ("Ann", "Lonely", "does")))
    assert after.relations.count() == 5
    missing = store.dangling_relations(triples(spark, ("X", "Y", "r"), ("X", "X", "r"), ("Ann", "Bob", "r")))
    assert rows(missing) == [("X", "X", "r", "X"), ("X", "Y", "r", "X"), ("X", "Y", "r", "Y")]


def test_observations(spark, store):
    def notes(*data):
        return spark.createDataFrame(data, "entity string, observation string")

    after = store.add_observations(notes(("Bob", "drinks coffee"), ("Bob", "sleeps")))
    assert [o for e, o in rows(after.observations) if e == "Bob"] == ["drinks coffee", "sleeps"]
    with pytest.raises(ValueError, match="Nobody"):
        store.add_observations(notes(("Nobody", "x")))
    after = store.overwrite_observations(notes(("Ann", "only this")))
    assert [o for e, o in rows(after.observations) if e == "Ann"] == ["only this"] and after.observations.count() == 3


def test_delete_cascades(spark, store):
    after = store.delete_entities(names(spark, "Acme, Inc", "Nobody"))
    assert rows(after.relations) == [("Ann", "Bob", "knows")]
    assert after.entities.count() == 3 and after.observations.count() == 3
    assert after.dangling_relations(after.relations).count() == 0
    after = store.delete_relations(triples(spark, ("Ann", "Acme, Inc", "owns"), ("Bob", "Ann", "knows")))
    assert after.relations.count() == 3


@pytest.mark.parametrize(
    "query, mode, found",
    [
        ("TEA", "any_token", ["Acme, Inc", "Ann"]),
        ("tea coffee", "any_token", ["Acme, Inc", "Ann", "Bob"]),
        ("person tea", "all_tokens", ["Ann"]),  # the words sit in different fields
        ("likes tea", "exact_phrase", ["Ann"]),
        ("tea likes", "exact_phrase", []),
        ("tea  cups", "exact_phrase", []),
        ("  ", "any_token", []),
        ("  works late  ", "exact_phrase", ["Ann"]),
        ("inc", "any_token", ["Acme, Inc"]),
    ],
)
def test_search(store, query, mode, found):
    result = store.search(query, mode)
    assert [r[0] for r in rows(result.entities)] == found
    assert all(r[0] in found and r[1] in found for r in rows(result.relations))


def test_search_mode_is_checked(store):
    with pytest.raises(ValueError):
        store.search("x", "fuzzy")


def test_search_and_open_keep_inner_relations(spark, store):
    assert rows(store.search("tea").relations) == [("Ann", "Acme, Inc", "owns"), ("Ann", "Acme, Inc", "works_at")]
    opened = store.open_nodes(names(spark, "Ann", "Bob", "Nobody", "Ann"))
    assert opened.entities.count() == 2 and rows(opened.relations) == [("Ann", "Bob", "knows")]
    assert opened.observations.count() == 3


def _document(store) -> str:
    """The store as one JSON document, put together on the driver for comparison."""
    entities = {
        r["name"]: {"name": r["name"], "entity_type": r["entity_type"], "observations": []} for r in store.entities.collect()
    }
    for r in store.observations.collect():
        entities[r["entity"]]["observations"].append(r["observation"])
    relations = {
        f"{r['src']},{r['dst']},{r['relation_type']}": {
            "relation_from": r["src"],
            "relation_to": r["dst"],
            "relation_type": r["relation_type"],
        }
        for r in store.relations.collect()
    }
    return json.dumps({"entities": entities, "relations": relations}, separators=(",", ":"), ensure_ascii=False)


def test_size_equals_the_json_document(spark, store):
    tricky = store.upsert_entities(batch(spark, (1, 'quo"te', "back\\slash", ["new\nline", "ünïcode"])))
    for s in (store, tricky):
        size = s.size().first()
        assert size["json_chars"] == len(_document(s)) and size["size_class"] == "small"
    empty = EntityStore.empty(spark).size().first()
    assert (empty["json_chars"], empty["size_class"]) == (len('{"entities":{},"relations":{}}'), "empty")


@pytest.mark.parametrize("n, label", [(18_000, "small"), (30_000, "medium"), (60_000, "large"), (90_000, "large")])
def test_size_classes(spark, n, label):
    assert make(spark, [("x" * n, "t")], [], []).size().first()["size_class"] != "empty"
    half = make(spark, [("x" * (n // 2), "t")], [], []).size().first()
    assert half["size_class"] == label


def test_numbering_is_dense_within_entities(spark):
    """One entity holds most observations; its numbers still run without gaps."""
    notes = [("hot", f"note {i}") for i in range(3000)] + [(f"e{i % 50}", f"x{i}") for i in range(200)]
    entities = [(e, "t") for e in {n[0] for n in notes}]
    numbered = make(spark, entities, notes, []).numbered_observations()
    per = {}
    for entity, _, i in rows(numbered):
        per.setdefault(entity, []).append(i)
    assert sum(map(len, per.values())) == 3200
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_export_keeps_parallel_relations(store):
    nodes = store.nodes()
    assert nodes.count() == 8 and ("Ann__obs_1", "observation") in {(r["node_id"], r["node_type"]) for r in nodes.collect()}
    edges = store.edges()
    assert edges.filter(F.col("edge_type") == "relation").count() == 4
    assert edges.filter(F.col("edge_type") == "has_observation").count() == 4
    assert tuple(store.stats().first()) == (4, 4, 4)


def test_save_and_load(spark, store):
    path = work_dir(spark, "store")
    assert EntityStore.load(spark, path).entities.count() == 0
    store.save(path)
    loaded = EntityStore.load(spark, path)
    assert rows(loaded.relations) == rows(store.relations) and rows(loaded.entities) == rows(store.entities)
    # The next version may be derived from the one being replaced.
    loaded.delete_entities(names(spark, "Acme, Inc")).save(path)
    assert EntityStore.load(spark, path).entities.count() == 3


def test_a_broken_version_is_not_an_empty_store(spark, store):
    path = work_dir(spark, "store")
    version = store.save(path)
    part = spark.read.parquet(f"{path}/{version}/entities")
    part.write.mode("overwrite").format("json").save(f"{path}/{version}/relations")
    with pytest.raises(Exception):
        EntityStore.load(spark, path).relations.collect()


def test_indexed_search_equals_the_scan(spark, tmp_path):
    texts = ["banana bandana", "ana", "an", "a", "", "Straße 12", "ÉTÉ été", "x" * 5000 + "yz", "a\0b", "ban ana", "漢字 ban"]
    store = EntityStore(
        spark.createDataFrame([(f"e{i}", f"kind {i % 3}") for i in range(len(texts))], "name string, entity_type string"),
        spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)] + [("e1", "banana"), ("e1", "ana")], "entity string, observation string"),
        spark.createDataFrame([("e0", "e1", "r")], "src string, dst string, relation_type string"),
    )
    store.save(str(tmp_path / "store"), index=True)
    indexed = EntityStore.load(spark, str(tmp_path / "store"))
    for query in ["ana", "an", "a", "nan", "banana", "ana kind", "an na zz", "été", "straße 2", "xxx yz", "字", "kind 1", "e1 ana ana", "nab", "n b", " "]:
        for mode in ("any_token", "all_tokens", "exact_phrase"):
            want = sorted(r["name"] for r in store.matching_names(query, mode).collect())
            assert sorted(r["name"] for r in indexed.matching_names(query, mode).collect()) == want, (query, mode)
    plan = indexed.matching_names("ana kind", "all_tokens")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "In(trigram" in plan
    prefix = indexed.matching_names("an", "any_token")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(trigram,an)" in prefix
    changed = indexed.add_observations(spark.createDataFrame([("e2", "zebra")], "entity string, observation string"))
    assert changed.postings is None and [r["name"] for r in changed.matching_names("zebra").collect()] == ["e2"]
    assert indexed.search("banana").relations.count() == 1


def test_an_index_has_a_row_for_a_trigram_not_for_a_place(spark, tmp_path):
    """A store of 480,000 characters of few kinds; its index needs no shuffle and about two bytes a character."""
    rng = random.Random(5)
    notes = [(f"e{i % 40}", "".join(rng.choices("abcdefgh ", k=2000))) for i in range(240)]
    store = make(spark, [(f"e{i}", "kind") for i in range(40)], notes, [])
    index = postings(store._texts())
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert index.count() < 40_000
    version = store.save(str(tmp_path / "store"), index=True)
    written = sum(p.stat().st_size for p in (tmp_path / "store" / version / "postings").glob("*.parquet"))
    assert written < 2.5 * 480_000
    for phrase in ("abc", "h", " a", "bcdefa", notes[7][1][990:1010]):
        found = EntityStore.load(spark, str(tmp_path / "store")).matching_names(phrase, "exact_phrase").collect()
        assert {r["name"] for r in found} == {e for e, t in notes if phrase.strip() in t}, phrase


def test_texts_longer_than_what_is_sorted_together(spark):
    """Cuts inside texts lose no phrase; more kinds of characters than fit one number with the place; ends of texts match nothing."""
    wide = "".join(map(chr, [*range(0x4E00, 0xA000), *range(0xAC00, 0xD7A4), *range(0x20000, 0x2A6E0)]))
    texts = [("long", "0123456789" * 30 + "end"), ("short", "9"), ("short", "end\0"), ("wide", wide), (None, "nobody"), ("end", "end"), ("none", None)]
    frame = spark.createDataFrame(texts, "name string, text string").coalesce(1)
    phrases = ["8901234567890123", "9e", "9end", "end\0", "end\0\0", "d", "9", "90", "nobody", wide[40_000:40_010], "\0", "zz"]
    want = sorted({(str(name), k) for name, t in texts for k, p in enumerate(phrases) if t is not None and p in t})
    for chunk in (7, 1000, 1 << 23):
        if chunk == 7:
            some = frame.filter("name IS NULL OR name != 'wide'")
            assert sorted((str(r["name"]), r["phrase"]) for r in containing(postings(some, chunk), phrases).collect()) == [w for w in want if w[0] != "wide"]
        else:
            assert sorted((str(r["name"]), r["phrase"]) for r in containing(postings(frame, chunk), phrases).collect()) == want, chunk
