"""The merged tree against a plain walk over the same documents."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from wortlaut.operators import structure


def local(name):
    return name.rsplit("}", 1)[-1]


def random_xml(rng, depth=0):
    tag = rng.choice("abc") if depth else rng.choice(["r", "q"])
    attrs = "".join(f' {n}="{rng.randrange(30)}"' for n in ("k", "m", "xml:id") if rng.random() < 0.4)
    inside = "".join(
        rng.choice([f"t{rng.randrange(9)} ", " ", "long " * 40, random_xml(rng, depth + 1) if depth < 4 else ""])
        for _ in range(rng.randrange(4))
    )
    return f"<{tag}{attrs}>{inside}</{tag}>"


def brute_tree(docs):
    """Rows in display order: (id, kind, sampled values)."""
    found = {}

    def visit(node, above):
        path = (*above, local(node.tag))
        entry = found.setdefault(path, {"children": [], "attrs": {}, "texts": []})
        if above and path[-1] not in found[above]["children"]:
            found[above]["children"].append(path[-1])
        for name, value in node.attrib.items():
            values = entry["attrs"].setdefault(local(name), [])
            if value not in values and len(values) < 20:
                values.append(value)
        text = (node.text or "").strip()[:120]
        if text and text not in entry["texts"] and len(entry["texts"]) < 5:
            entry["texts"].append(text)
        for child in node:
            visit(child, path)

    for xml in docs:
        visit(ET.fromstring(xml), ())
    rows = []

    def flatten(path):
        name, entry = "/".join(path), found[path]
        rows.append((name, "tag", []))
        rows.extend((f"{name}/@{a}", "attr", entry["attrs"][a]) for a in sorted(entry["attrs"]))
        if entry["texts"]:
            rows.append((f"{name}/#text", "text_content", []))
        for child in entry["children"]:
            flatten((*path, child))

    for root in sorted(p for p in found if len(p) == 1):
        flatten(root)
    return rows, found


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    return {f"d{i:03}.xml": random_xml(rng) for i in range(80)}


@pytest.fixture(scope="module")
def nodes(docs, make_corpus):
    return make_corpus(docs).nodes.cache()


@pytest.fixture(scope="module")
def rows(nodes):
    return structure.tree_rows(nodes).cache()


def ids(df):
    return [r["id"] for r in df.orderBy("sort_key").collect()]


def test_rows_in_depth_first_order(docs, rows):
    want, _ = brute_tree(docs.values())
    got = [(r["id"], r["kind"], r["attr_values"]) for r in rows.orderBy("sort_key").collect()]
    assert got == want


def test_parts_agree_with_the_tree(docs, nodes, rows):
    _, found = brute_tree(docs.values())
    texts = {r["path"]: r["text_examples"] for r in structure.path_texts(nodes).collect()}
    assert texts == {"/".join(p): e["texts"] for p, e in found.items() if e["texts"]}
    attrs = {(r["path"], r["attr"]): r["attr_values"] for r in structure.path_attrs(nodes).collect()}
    assert attrs == {("/".join(p), a): v for p, e in found.items() for a, v in e["attrs"].items()}
    for r in structure.path_tree(nodes).collect():
        if r["parent_path"]:
            assert found[tuple(r["parent_path"].split("/"))]["children"][r["child_rank"] - 1] == r["tag"]
        assert r["has_text"] == bool(found[tuple(r["path"].split("/"))]["texts"])
    for r in rows.collect():
        assert r["inline_attr_values"] == r["attr_values"][:5]
        assert r["extra_attr_count"] == max(0, len(r["attr_values"]) - 5)
        if r["kind"] == "tag":
            entry = found[tuple(r["id"].split("/"))]
            assert r["has_children"] == bool(entry["children"] or entry["attrs"] or entry["texts"])


def brute_visible(rows, collapsed):
    """Rows in order, hidden below any collapsed tag."""
    shown, stack = [], []
    for row in rows:
        while stack and stack[-1][0] >= row["depth"]:
            stack.pop()
        if not any(closed for _, closed in stack):
            shown.append(row["id"])
        if row["kind"] == "tag":
            stack.append((row["depth"], row["id"] in collapsed))
    return shown


def test_collapse(rows, spark):
    ordered = rows.orderBy("sort_key").collect()
    for depth in (0, 1, 2):
        closed = {r["id"] for r in ordered if r["kind"] == "tag" and r["has_children"] and r["depth"] >= depth}
        view = structure.default_collapse(rows, depth)
        assert ids(structure.visible_rows(view)) == brute_visible(ordered, closed)
        assert {r["id"] for r in view.filter("is_collapsed").collect()} == closed
        assert {r["id"] for r in structure.collapsible(rows, depth).collect()} == closed
    some = [r["id"] for r in ordered if r["kind"] == "tag"][1::3]
    view = structure.set_visibility(rows, spark.createDataFrame([(i,) for i in some], "id string"))
    assert ids(structure.visible_rows(view)) == brute_visible(ordered, set(some))
    assert {r["id"] for r in view.filter("is_collapsed").collect()} == set(some)
    none = structure.set_visibility(rows, spark.createDataFrame([], "id string"))
    assert ids(structure.visible_rows(none)) == [r["id"] for r in ordered]
    assert none.columns == rows.columns


def test_search(rows, spark):
    found = structure.search_tree(rows, "@M")
    hits = {r["id"] for r in found.filter("is_search_match").collect()}
    assert hits == {r["id"] for r in rows.filter("label = '@m'").collect()}
    tags = {h.rsplit("/", 1)[0] for h in hits}
    above = {"/".join(t.split("/")[:i]) for t in tags for i in range(1, t.count("/") + 2)}
    kept = {r["id"] for r in rows.collect() if r["path"] in above}
    assert set(ids(found)) == kept
    assert structure.search_tree(rows, " ").count() == rows.count()
    assert structure.search_tree(rows, "no such thing").count() == 0


def test_projection(docs, rows, make_corpus):
    name = "d003.xml"
    corpus = make_corpus(docs)
    _, own = brute_tree([docs[name]])
    shown = structure.project_doc(rows, corpus.document(name).nodes)
    for r in shown.collect():
        entry = own.get(tuple(r["path"].split("/")), {"attrs": {}, "texts": []})
        if r["kind"] == "attr":
            values = entry["attrs"].get(r["label"][1:], [])
            assert (r["inline_attr_values"], r["has_content"]) == (values[:5], bool(values))
        if r["kind"] == "text_content":
            assert r["example_value"] == (entry["texts"][0] if entry["texts"] else "...")
            assert r["example_loaded"] and r["has_content"] == bool(entry["texts"])
    back = structure.all_docs(shown)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_examples(docs, nodes, rows):
    _, found = brute_tree(docs.values())
    path = next("/".join(p) for p, e in found.items() if len(p) == 2 and len(e["texts"]) > 2)
    first = structure.find_example(nodes, path).first()["example"]
    assert first == found[tuple(path.split("/"))]["texts"][0]
    assert structure.find_example(nodes, path, exclude=first).first()["example"] != first
    assert structure.find_example(nodes, path, file_suffix="nowhere.xml").count() == 0
    attr = rows.filter("kind = 'attr'").first()
    listed = structure.attr_row_values(rows, attr["id"]).orderBy("no").select(F.collect_list("value")).first()[0]
    assert listed == attr["attr_values"]


def test_values_kept_per_partition_are_the_first(monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    facts = [(rng.choice("ab"), "attr", "n", str(rng.randrange(60)), rng.randrange(50), i) for i in range(4000)]
    table = pd.DataFrame(facts, columns=["path", "kind", "name", "value", "doc_ord", "place"])
    frames = [table[i : i + 37] for i in range(0, len(table), 37)]
    for merge_rows, emit_rows in ((100, 10**9), (100, 10), (10**9, 10**9)):
        monkeypatch.setattr(structure, "_MERGE_ROWS", merge_rows)
        monkeypatch.setattr(structure, "_EMIT_ROWS", emit_rows)
        kept = pd.concat(list(structure._first_values(iter(frames))))

        def first(rows, path):
            ordered = rows[rows.path == path].sort_values(["doc_ord", "place"]).drop_duplicates("value")
            return [tuple(r) for r in ordered.head(20).to_numpy()]

        for path in "ab":
            assert first(kept, path) == first(table, path)
        assert len(kept) < len(table)


def test_sample_limits_are_parameters(make_corpus):
    nodes = make_corpus({"a.xml": "<r>" + "".join(f'<s v="{i}">text {i} long</s>' for i in range(9)) + "</r>"}).nodes
    rows = structure.samples(nodes, max_values=3, max_texts=4, max_length=6).filter("kind <> 'tag'").collect()
    assert {r["kind"]: r["values"] for r in rows} == {
        "attr": ["0", "1", "2"], "text_content": ["text 0", "text 1", "text 2", "text 3"],
    }
