"""The subpackage's operators against brute force, their SQL twins, and on awkward rows."""

import itertools
import os
import random
import sys
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connection, rows  # noqa: E402
from larkspur.llm import boosting, encode, examples, formatting, leakage, links, markup, near_duplicates, neighbours, queries, rank_fusion, splitting, sql, visual, words  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in sql.SQL:
        want = con.execute(sql.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def pairs(df):
    return {tuple(r) for r in df.collect()}


# ---- links


def test_links_of_hot_groups_stay_linear_and_connected(spark):
    data = [("hot", i, i % 7) for i in range(500)] + [("small", i, i) for i in range(1000, 1004)] + [("same", 1, 5), ("same", 2, 5), (None, 1, 1), (None, 2, 2)]
    got = pairs(links.linked_pairs(spark.createDataFrame(data, "g string, item long, variant long"), ["g"], "item", "variant"))
    assert {p for p in got if p[0] >= 1000} == set(itertools.combinations(range(1000, 1004), 2))
    hot = {p for p in got if p[1] < 1000}
    assert len(hot) <= 500 and {x for p in hot for x in p} == set(range(500)) and all(a % 7 != b % 7 for a, b in hot)
    assert links.linked_pairs(spark.createDataFrame([], "g string, item long"), ["g"], "item").count() == 0


@pytest.mark.parametrize(("block", "hot"), [(256, 100_000), (16, 50)])
def test_hot_groups_give_every_pair(spark, monkeypatch, block, hot):
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "HOT", hot)
    same = spark.createDataFrame([(f"h{i:03d}", "Text" + " " * i + "one") for i in range(200)], "hash string, doc string")
    assert pairs(formatting.formatting_pairs(same)) == set(itertools.combinations([f"h{i:03d}" for i in range(200)], 2))
    texts = ["a flow"] * 63 + ["\u0430 flow", "a \ufb02ow"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pairs(visual.same_look_pairs(docs)) == {(a, b) for a, b in itertools.combinations(range(65), 2) if texts[a] != texts[b]}
    near = spark.createDataFrame([(f"{i:02d}", "a b c d e f g h" + "." * i) for i in range(70)] + [("x", "a b c d e f g h i")], "hash string, doc string")
    assert pairs(near_duplicates.near_duplicate_pairs(near, width=3, threshold=0.6)) == set(itertools.combinations([*(f"{i:02d}" for i in range(70)), "x"], 2))


# ---- 1


def test_formatting(spark):
    base = "---\ntitle: A b\nowner: x\n---\n\n# Größe und Maß\n\nText, 12 words."
    data = [
        ("a", base), ("b", base.upper().replace("SS", "ß")), ("c", "---\nowner: x\ntitle: A b\n---\n# größe   UND maß text 12; words"), ("d", "title a b owner x größe und maß text 12 words"), ("a", base),
        ("e", "---\nowner: x\ntitle: A b\nnever closed größe und maß text 12 words"), ("n", None), ("o", ""), ("p", " .,; \n"), (None, base), ("q", "ﬁx"), ("r", "fix"), ("s", "ΟΔΟΣ"), ("t", "οδος"), ("u", "οδοσ"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], "hash string, doc string, form int")
    got = pairs(formatting.formatting_pairs(df))
    assert got == {("a", "b"), ("a", "c"), ("b", "c")} | {("s", "t"), ("s", "u"), ("t", "u")}
    groups = {r["representative"]: r["copies"] for r in formatting.formatting_groups(df).collect()}
    assert groups["a"] == 3 and groups["q"] == groups["r"] == 1 and "n" not in groups
    assert formatting.formatting_pairs(df.limit(0)).count() == 0 and formatting.formatting_groups(df.limit(0)).count() == 0
    long = spark.createDataFrame([("x", "Ab " * 200_000), ("y", "aB-" * 200_000)], "hash string, doc string")
    assert pairs(formatting.formatting_pairs(long)) == {("x", "y")}


# ---- 2


def test_rank_fusion(spark):
    nan = float("nan")
    lists = spark.createDataFrame(
        [(1, 0, 1.0, "higher", 1), (1, 1, 1.0, "lower", 1), (1, 2, 0.0, "higher", 1), (1, 3, 1.0, "higher", 1), (1, 3, 9.0, "higher", 0), (1, 4, nan, "higher", 1), (1, 5, None, "higher", 1), (2, 0, 1.0, "higher", 1)],
        "request_id long, list_no int, weight double, better string, logged_at int",
    )
    results = spark.createDataFrame(
        [
            (1, 0, "c", "a", 1e9), (1, 0, "c", "b", 2.0), (1, 0, "c", "z", None), (1, 0, "c", "y", nan), (1, 1, "c", "b", -5.0), (1, 1, "c", "a", 3.0), (1, 1, "c", "a", 4.0), (1, 2, "c", "a", 9.0),
            (1, 3, "c", "b", 1.0), (1, 3, "c", "b", 1.0), (1, 4, "c", "a", 1.0), (1, 5, "c", "a", 1.0), (1, 9, "c", "a", 1.0), (1, 0, None, "a", 7.0), (3, 0, "c", "a", 7.0),
        ],
        "request_id long, list_no int, collection string, path string, score double",
    )
    got = [(r["request_id"], r["path"], round(r["score"], 9), r["rank"]) for r in rank_fusion.fused_ranking(results, lists).orderBy("request_id", "rank").collect()]
    assert got == [(1, "b", round(2 / 61 + 1 / 62, 9), 1), (1, "a", round(1 / 61 + 1 / 62, 9), 2)]
    assert rank_fusion.fused_ranking(results.limit(0), lists).count() == 0 and rank_fusion.fused_ranking(results, lists.limit(0)).count() == 0


# ---- 3


def vectors(n=1500, width=64, near=150, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, width))
    for i in range(near):
        v[i] = v[near + i // 3] + rng.standard_normal(width) * 0.25
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")


def test_neighbours(spark):
    v = vectors()
    bad = [("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 48), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), ("hole", [None] + [1.0] * 63)]
    data = [(f"k{i:05d}", (v[i] * (1 + i % 3)).tolist()) for i in range(len(v))]
    df = spark.createDataFrame(data + data[:20] + bad + [(None, v[0].tolist())], "hash_seq string, embedding array<float>")
    s = v @ v.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    want = {(f"k{i:05d}", f"k{j:05d}") for i, j in zip(*np.nonzero((s >= 0.9) & (s >= fifth[:, None]) & (s >= fifth[None, :])), strict=True) if i < j}
    got = {(r["a"], r["b"]) for r in neighbours.mutual_neighbours(df).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)
    near = defaultdict(set)
    for r in neighbours.nearest(df).collect():
        near[r["key"]].add(r["neighbour"])
    assert len(near) == len(v) and all(len(x) == 5 for x in near.values())
    top = np.argsort(-s, axis=1)[:, :5]
    recall = np.mean([f"k{j:05d}" in near[f"k{i:05d}"] for i in range(len(v)) for j in top[i]])
    assert recall >= 0.9
    found = neighbours.search(df, df.where("hash_seq like '%50'")).collect()
    hits = [f"k{j:05d}" in {r["neighbour"] for r in found if r["key"] == f"k{i:05d}"} for i in range(50, len(v), 100) for j in top[i]]
    assert np.mean(hits) >= 0.9
    # Queries that aren't in the index find their nearest as well.
    outside = neighbours.search(df.where("hash_seq not like '%50'"), df.where("hash_seq like '%50'")).collect()
    inside = np.array([j for j in range(len(v)) if j % 100 != 50])
    nearest = {f"k{i:05d}": {f"k{j:05d}" for j in inside[np.argsort(-s[i, inside])[:5]]} for i in range(50, len(v), 100)}
    assert np.mean([n in {r["neighbour"] for r in outside if r["key"] == k} for k, ns in nearest.items() for n in ns]) >= 0.9
    assert neighbours.mutual_neighbours(df.limit(0)).count() == 0 and neighbours.nearest(df.limit(0)).count() == 0


def test_pairs_of_many_equal_vectors(spark):
    v = vectors(40, near=0)
    near = v[1] + 0.02 * v[2]
    data = [(f"same{i:03d}", v[0].tolist()) for i in range(80)] + [("close", (v[0] + 0.02 * v[3]).tolist()), ("one", v[1].tolist()), ("two", v[1].tolist()), ("near", near.tolist())]
    got = {(r["a"], r["b"]) for r in neighbours.mutual_neighbours(spark.createDataFrame(data + data[:9], "hash_seq string, embedding array<float>")).collect()}
    assert got == set(itertools.combinations([f"same{i:03d}" for i in range(80)], 2)) | {("one", "two"), ("near", "one"), ("near", "two")}


def test_start_grows_with_the_rows(spark):
    v = vectors(2000, near=0, seed=5)
    for i in range(0, 400, 2):  # pairs at 0.5
        r = v[i + 1] - (v[i] @ v[i + 1]) * v[i]
        v[i + 1] = 0.5 * v[i] + 0.75**0.5 * r / np.linalg.norm(r)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    edges = {(r["src"], r["dst"]) for r in neighbours.neighbour_graph(points, 200, 64, orders=2, rounds=0, run_rows=100).collect()}
    assert sum((i, i + 1) in edges for i in range(0, 400, 2)) >= 0.95 * 200


def test_many_equal_vectors_stay_bounded(spark):
    v = vectors(40, near=3)
    data = [(f"same{i:04d}", v[0].tolist()) for i in range(600)] + [(f"k{i}", x.tolist()) for i, x in enumerate(v[10:])]
    df = spark.createDataFrame(data, "hash_seq string, embedding array<float>")
    got = neighbours.nearest(df).collect()
    assert len(got) == 5 * len(data)
    assert all(r["similarity"] > 0.999 for r in got if r["key"].startswith("same"))


def test_pairs_above_a_floor():
    v = vectors(300, near=60)
    s = v @ v.T
    rows_, columns, sims = neighbours._above(v, 0.8, 10, tile=64)
    assert {(int(a), int(b)) for a, b in zip(rows_, columns, strict=True)} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.8), strict=True) if i < j}
    assert np.allclose(sims, s[rows_, columns])
    assert neighbours._above(np.ones((200, 4), np.float32), 0.5, 3) is None


# ---- 4


def headings(data: bytes):
    """Plain restatement of the rule for headings at which a text can be cut."""
    lines, at, out = data.split(b"\n"), 0, []
    front = None
    if lines[0] == b"---":
        front = next((i for i in range(1, len(lines)) if lines[i] == b"---"), None)
    fence = None
    for i, line in enumerate(lines):
        if front is not None and i <= front:
            pass
        elif fence:
            fence = None if line[:3] == fence else fence
        elif line[:3] in (b"```", b"~~~"):
            fence = line[:3]
        elif at and line.startswith(b"#") and len(line) - len(line.lstrip(b"#")) <= 6 and line.lstrip(b"#").startswith(b" "):
            out.append(at)
        at += len(line) + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b c", "####### no", "#no", "", "---", "```", "```py", "~~~", "text é字", "- x", " # in", "# "]), max_size=40))
def test_headings(lines):
    data = "\n".join(lines).encode()
    positions, kinds, depths = splitting.cut_points(data)
    assert [int(p) for p, k in zip(positions, kinds, strict=True) if k == splitting.HEADING] == headings(data)
    assert len(positions) == len(kinds) == len(depths)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é字\n#-` 👩", max_size=3000), st.sampled_from([(64, 10), (200, 30), (2048, 308)]))
def test_pieces_cover(text, sizes):
    data = text.encode()
    parts = splitting.pieces(data, *sizes)
    assert parts[0][0] == 0 and parts[-1][1] == len(data)
    for a, b in parts:
        assert b - a <= sizes[0]
        data[a:b].decode()
    for (a, b), (c, d) in itertools.pairwise(parts):
        assert a < c <= b < d and b - c <= 2 * sizes[1]


def test_split(spark):
    topic_a, topic_b = "engine piston valve torque clutch gearbox. ", "garden flower blossom petal meadow orchard. "
    doc = (topic_a * 5 + "\n") * 6 + (topic_b * 5 + "\n") * 6
    ends = [b for _, b in splitting.pieces(doc.encode())]
    assert len((topic_a * 5 + "\n") * 6) in ends  # the change of topic is where it is cut
    # One paragraph without line breaks is cut between sentences, at the change of topic.
    for size in (1100, 1500, 2048):
        line = "".join(topic * 24 for topic in (topic_a, topic_b, topic_a)).encode()
        cuts = [b for _, b in splitting.pieces(line, size, 100)][:-1]
        assert all(line[b - 2 : b] == b". " for b in cuts) and len(topic_a * 24) in cuts
    df = spark.createDataFrame([("a", doc), ("a", doc), ("b", "short"), ("c", None), (None, doc), ("d", "x" * 5000), ("e", "")], "hash string, doc string")
    got = defaultdict(list)
    for r in splitting.split(df).orderBy("key", "seq").collect():
        got[r["key"]].append((r["pos"], r["text"]))
    assert got.keys() == {"a", "d"}
    assert all(doc.encode()[p : p + len(t.encode())] == t.encode() for p, t in got["a"])
    assert splitting.split(df.limit(0)).count() == 0 and splitting.boundaries(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(b"x" * 100, 30, 20)


# ---- 5


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.BoostedTrees(trees=40, depth=3).fit(x[:600], y[:600])
    assert ((model.margin(x[600:]) > 0) == (y[600:] > 0.5)).mean() > 0.93


def right_nodes(trees, sources, seed, plain_only=False):
    r, right, total = random.Random(seed), 0, 0
    for _ in range(300):
        text, spans = markup.training_text(r, sources)
        nodes = markup.parse(text)
        if nodes:
            for n, y in zip(nodes, markup.decode(nodes, trees.margin(markup.features(text, nodes))), strict=True):
                truth = any(a < n.end and n.start < b and n.start >= a - 1 for a, b in spans)
                if n.kind != markup.KIND["list"] and not (truth and plain_only):
                    right += y == truth
                    total += 1
    return right / total


def test_markup_held_out():
    assert right_nodes(markup.classifier(), tuple(examples.PLAIN), 77) > 0.98


@pytest.mark.parametrize("source", ["rust", "shell", "r", "prices"])
def test_markup_of_a_source_never_seen(source):
    """Signs of a language the trees weren't fitted on are mostly left alone."""
    trees = markup.classifier(markup.TRAINING_TEXTS, tuple(s for s in examples.PLAIN if s != source))
    assert right_nodes(trees, (source,), 5, plain_only=True) > 0.9


CLEAN = [
    ("<h2>Head</h2>\nText <b>bold</b> &amp; more.", "## Head\n\nText bold & more."),
    ("# Head\n\n- one\n- two", "# Head\n\n- one\n- two"),
    ("<ul><li>one</li><li>two</li></ul>", "- one\n- two"),
    ("A [link](x.md), `code` and **strong**.", "A link, `code` and strong."),
    ("A ''wiki'' [[Page|label]] [[Category:X]] text.", "A wiki label text."),
    ("\\section{Head}\nA \\textbf{bold} word \\cite{x1} and $x_{1}^{2}$.", "## Head\n\nA bold word and $x_{1}^{2}$."),
    ("```\na = **b**\n```", "```\na = **b**\n```"),
    ("<pre><code>if a &lt; 3</code></pre>", "```\nif a < 3\n```"),
]


@pytest.mark.parametrize(("text", "clean"), CLEAN)
def test_clean_text(text, clean):
    (nodes, chosen), *_ = markup._judged([text], markup.classifier())
    assert markup.clean(text, nodes, chosen).strip() == clean


PLAIN = ["if a < b and c > 9", "x <- y -> z", "R&D costs $9 or $10", "file_name_9 and _word", "5 * 6 * 2", "C:\\notes\\Foo", "C# is #16", "2^9 {x, y}", "note *) [9] (see [8])", "A&B; then 3 | 4", "~9% == 4"]
CODE = ["vector<int> v = {1, 2};", "List<String> items", "regex \\d+ and \\w", "__init__ calls __len__", "f(*args, **kwargs)", "a *) b (* c", "x->y && z || !w", "cat a | sort > b", "#include <stdio.h>", "${HOME}/x_*", "p < 0.05, q > 3"]


@pytest.mark.parametrize("text", CODE)
def test_code_in_a_text_stays(text):
    (nodes, chosen), *_ = markup._judged([f"Some words before {text} and some after them."], markup.classifier())
    assert not chosen.any()


LONG = [
    ("see \\footnote{" + "word " * 600 + "tail} here", "see  (" + "word " * 600 + "tail) here"),
    ("**" + "bold " * 300 + "end**", "bold " * 300 + "end"),
    ("an ''" + "italic " * 200 + "end'' word", "an " + "italic " * 200 + "end word"),
    ("a ``" + "quoted " * 200 + "end'' word", "a " + "quoted " * 200 + "end word"),
    ("so \\[" + "x + " * 300 + "1\\] holds", "so \\[" + "x + " * 300 + "1\\] holds"),
    ("so $" + "x + " * 100 + "1$ holds", "so $" + "x + " * 100 + "1$ holds"),
]


@pytest.mark.parametrize(("text", "clean"), LONG)
def test_long_constructs(text, clean):
    (nodes, chosen), *_ = markup._judged([text], markup.classifier())
    assert chosen.any() and markup.clean(text, nodes, chosen) == clean


def test_openings_without_end_take_linear_time():
    for sign in ("**a ", "``a ", "\\a{", "[[a", "'''a ", "$a ", "\\[a ", "<b "):
        assert len(markup.parse(sign * 20_000)) > 0


def test_found_rows(spark):
    data = [(f"p{i}", f"Some words before {t} and some after them.") for i, t in enumerate(PLAIN)] + [(f"m{i}", t) for i, (t, _) in enumerate(CLEAN) if t != CLEAN[1][0]] + [("n", None), ("e", ""), ("m0", CLEAN[0][0]), ("m9", "stray </div> tag")]
    got = markup.cleaned(spark.createDataFrame([(*r, "x") for r in data], "_id string, text string, constructs string"), "_id", "text").collect()
    assert {r["key"] for r in got if r["constructs"]} == {k for k, _ in data if k.startswith("m")}
    assert {r["key"]: r["text"] for r in got if r["key"] in "ne"} == {"n": None, "e": ""}
    deep = "<div>" * 400 + "x" + "</div>" * 400
    assert markup.cleaned(spark.createDataFrame([("a", deep), ("b", "**a " * 20_000)], "_id string, text string"), "_id", "text").count() == 2


# ---- 6


def edited(r, tokens, share):
    out = list(tokens)
    for _ in range(int(len(out) * share)):
        at = r.randrange(len(out))
        out[at : at + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"]
    return out


def test_near_duplicates(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    data, texts = [], {}
    for i in range(120):
        base = r.choices(vocabulary, k=r.choice([6, 12, 60, 150, 400]))
        for j, share in enumerate([0, 0, 0.02, 0.05, 0.1]):
            tokens = edited(r, base, share)
            texts[f"{i:03d}-{j}"] = " ".join(tokens) if j else ", ".join(tokens).upper()
    data = list(texts.items()) + list(texts.items())[:9] + [("null", None), ("empty", ""), ("two", "a b"), (None, "x y z"), ("t1", "a b c"), ("t2", "A-b. C"), ("u4", "q1 q2 q3 q4"), ("u5", "q1 q2 q3 q4 q5")]
    df = spark.createDataFrame([(*x, 0) for x in data], "hash string, doc string, class int")
    texts |= {"t1": "a b c", "t2": "a b c", "u4": "q1 q2 q3 q4", "u5": "q1 q2 q3 q4 q5"}
    runs = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in texts.items() for w in [words.WORD.findall(t.lower())]}
    at = defaultdict(set)
    for k, s in runs.items():
        for x in s:
            at[x].add(k)
    near = {tuple(sorted(p)) for ks in at.values() for p in itertools.combinations(ks, 2)}
    want = {(a, b) for a, b in near if len(runs[a] & runs[b]) >= 0.6 * len(runs[a] | runs[b])}
    got = pairs(near_duplicates.near_duplicate_pairs(df, width=3, threshold=0.6))
    assert got <= want and len(want - got) <= 0.003 * len(want)
    assert ("t1", "t2") in got and ("u4", "u5") in got
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_near_duplicates_that_repeat_themselves(spark):
    data = []
    for i in range(12):
        text = " ".join(f"r{i}x{j}" for j in range(30))
        data += [(f"{i:02d}-once", text), (f"{i:02d}-thrice", " ".join([text] * 3))]
    df = spark.createDataFrame(data, "hash string, doc string")
    want = {(f"{i:02d}-once", f"{i:02d}-thrice") for i in range(12)}
    assert pairs(near_duplicates.near_duplicate_pairs(df, width=3, threshold=0.6)) == want  # 28 of 30 distinct runs
    assert pairs(near_duplicates.near_duplicate_pairs(df)) == want  # 26 of 30


def test_near_duplicates_with_scattered_edits(spark):
    data = []
    for i in range(400):
        text = [f"e{i}x{j}" for j in range(303)]
        other = list(text)
        for e in range(24):
            other[6 + 12 * e] = f"f{i}x{e}"  # 229 of 373 distinct runs are in both
        data += [(f"{i:03d}-a", " ".join(text)), (f"{i:03d}-b", " ".join(other))]
    got = pairs(near_duplicates.near_duplicate_pairs(spark.createDataFrame(data, "hash string, doc string"), width=3, threshold=0.6))
    assert got == {(f"{i:03d}-a", f"{i:03d}-b") for i in range(400)}


def test_hot_bucket_keeps_every_pair(spark):
    prints = spark.createDataFrame([(i, 0, [7]) for i in range(300)] + [(1000, 5, [8]), (1001, 5, [8]), (1001, 5, [8])], "class long, sketch long, variants array<long>")
    got = pairs(near_duplicates.candidate_pairs(prints, 0.6))
    assert got == set(itertools.combinations(range(300), 2)) | {(1000, 1001)}


@pytest.mark.parametrize("tasks", [1, 40])
def test_hot_bucket_is_paired_in_blocks(spark, tasks):
    """A bucket of several blocks, salted where a task sees much of it and met whole where none does."""
    rng = np.random.default_rng(8)
    sketches = rng.integers(-(1 << 63), 1 << 63, 7000) & ~255
    sketches[6900:] = sketches[:100]
    prints = spark.createDataFrame([(i, int(x), [7, 100 + i]) for i, x in enumerate(sketches)], "class long, sketch long, variants array<long>").repartition(tasks)
    got = pairs(near_duplicates.candidate_pairs(prints, 0.9))
    most = near_duplicates._most_differing(near_duplicates.SKETCHED, 2, 0.9)
    close = near_duplicates._alike(sketches.view(np.uint64)[:, None], sketches.view(np.uint64)[None, :], most, 0)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True) if i < j}
    assert {(i, 6900 + i) for i in range(100)} <= got


def test_sketches_lose_few_pairs():
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(300):
        words_ = rng.integers(1 << 63, size=280, dtype=np.uint64)
        # 208 of 348 runs are shared
        other = np.append(words_[70:], rng.integers(1 << 63, size=70, dtype=np.uint64))
        both, at = np.concatenate([words_, other]), np.array([0, 280, 560])
        with np.errstate(over="ignore"):
            symbols = near_duplicates._symbols(both, at, np.arange(2), 3, 12)
        short, long = near_duplicates._sketches(symbols, np.array([278, 278]))
        most = near_duplicates._most_differing(near_duplicates.SKETCHED, 2, 0.6)
        lost += not near_duplicates._alike(short[:1], short[1:], most, 10)[0]
        lost += (long[0] != long[1]).sum() > near_duplicates._most_differing(48, 8, 0.6)
    assert lost <= 1
    assert near_duplicates._most_differing(48, 8, 0.6) < 40  # and they do drop pairs


def test_components(spark):
    r = random.Random(1)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [(f"{a:03d}", f"{b:03d}") for a, b in (r.sample(range(100, 200), 2) for _ in range(70))] + [("x", "x")]
    got = {r["node"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert near_duplicates.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups(spark):
    text = " ".join(f"w{i}" for i in range(100))
    content = spark.createDataFrame([("a", text), ("b", text + " more words at the end"), ("c", "other words here that are alone now"), ("d", text.upper())], "hash string, doc string")
    docs = spark.createDataFrame([("a", "c", "1.md"), ("a", "c", "2.md"), ("c", "c", "3.md")], "hash string, collection string, path string")
    got = {(r["hash"], r["path"]): (r["group_id"], r["links"], r["copies"]) for r in near_duplicates.near_duplicate_groups(content, docs).collect()}
    assert got == {("a", "1.md"): ("a", 1, 2), ("a", "2.md"): ("a", 1, 2), ("b", None): ("a", 1, 1), ("d", None): ("a", 1, 2)}


# ---- 8


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = encode.read_ranks(os.path.join(encode.TOKENIZERS, encode.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids(spark, sf, reference):
    ranks, library = reference
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, sf).collect()}
    assert got == {d["doc_id"]: library.encode_ordinary(d["text"]) if d["text"] else [] for d in docs}
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> a"), (4, "ab" * 20_000), (5, "\n \r\n\t"), (1, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["ids"]) for r in encode.encoded(strange).orderBy("doc_id").collect()]
    assert got[:2] == [(1, []), (1, [])] and got[2:] == [(i, library.encode_ordinary(t)) for i, t in ((2, ""), (3, "<|endoftext|> a"), (4, "ab" * 20_000), (5, "\n \r\n\t"))]
    assert all(encode.Encoder(ranks).merge(t) == [i] for t, i in list(ranks.items())[::50])


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=300))
def test_ids_of_any_text(reference, text):
    ranks, library = reference
    coder = encode.encoder(os.path.join(encode.TOKENIZERS, encode.VOCABULARY))
    assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)
    # The exact merge of long words agrees with that of short ones.
    for w in (w.encode("utf-8", "replace") for w in coder.split(text * 3)):
        assert coder._merge_long(w) == coder.merge(w) or len(w) == 1 or w in ranks


# ---- 9


@pytest.mark.parametrize("at_once", [200_000, 20])
def test_leaks(spark, monkeypatch, at_once):
    monkeypatch.setattr(leakage, "WINDOWS_AT_ONCE", at_once)
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate([30, 12, 9, 5, 1, 60])] + [("null", None), ("blank", " ?! "), (None, "v1 v2"), ("i0", "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 v12")]
    w = {k: t.split() for k, t in items[:6]}
    filler = lambda n: r.choices(vocabulary, k=n)
    cases = {
        1: filler(50) + w["i0"][3:15] + filler(9), 2: w["i0"][3:14] + filler(30), 3: w["i1"], 4: filler(5) + w["i2"], 5: w["i2"][:8] + filler(9), 6: filler(99) + w["i3"] + filler(3), 7: w["i5"][:20] + w["i5"][26:50],
        8: w["i5"][10:16] + ["zz"] + w["i5"][17:30], 9: [x for i, v in enumerate(w["i5"]) for x in ([v, "zz"] if i % 9 == 8 else [v])], 10: filler(450_000) + w["i1"],
    }
    docs = spark.createDataFrame([(k, " ".join(v).upper(), 1) for k, v in cases.items()] + [(20, None, 1), (21, "", 1), (1, " ".join(cases[1]), 1)], "doc_id long, text string, item_id int")
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, doc_id int")
    want = set()
    for k, text in items:
        t = words.WORD.findall(text or "")
        for d, v in cases.items():
            n = min(12, len(t))
            if n and k:
                parts = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
                if any(tuple(v[i : i + n]) in parts for i in range(len(v) - n + 1)):
                    want.add((d, k))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, asked).collect()}
    assert got == want and (8, "i5") in got and (2, "i0") not in got and (10, "i1") in got
    near = {(r["doc_id"], r["item_id"]): r["edits"] for r in leakage.leaks(docs, asked, edits=2).collect()}
    assert {k for k, e in near.items() if e == 0} == want
    assert (9, "i5") not in got and near[9, "i5"] in (1, 2)
    assert leakage.leaks(docs.limit(0), asked).count() == 0 and leakage.leaks(docs, asked.limit(0)).count() == 0


def test_leaks_of_short_items_with_edits(spark):
    r = random.Random(9)
    items, cases, filler = [], {}, [f"z{i}" for i in range(500)]
    for size in (9, 10, 12, 14, 15):
        for k in range(40):
            text = [f"s{size}x{k}x{j}" for j in range(size)]
            items.append((f"{size}-{k}", " ".join(text)))
            for n in (1, 2):
                out = list(text)
                for e in range(n):
                    at = r.randrange(1, len(out) - 1)
                    out[at : at + r.randint(0, 1)] = [f"new{e}"] * r.randint(0, 1)
                cases[f"{size}-{k}-{n}"] = r.choices(filler, k=r.randint(0, 20)) + out + r.choices(filler, k=r.randint(0, 20))
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in cases.items()], "doc_id string, text string")
    got = leakage.leaks(docs, spark.createDataFrame(items, "item_id string, text string"), edits=2).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k.rsplit("-", 1)[0]) for k in cases}
    assert all(r["edits"] <= int(r["doc_id"][-1]) for r in got)


# ---- 10


def test_same_look(spark):
    base = "Bako flow résumé 12 fix"
    data = [
        (1, base), (2, "Βakο flow résumé 12 fix"), (3, unicodedata.normalize("NFD", base)), (4, "Ｂako ﬂow résumé １２ ﬁx"), (5, "Ba\u200bko\u00a0flow\u2003résumé 12 fi\u00adx\ufeff"), (6, base.lower()), (7, "Bako flow resume 12 fix"),
        (8, "Bako  flow résumé 12 fix"), (9, base), (10, None), (11, ""), (12, "\u200b \u00a0"), (13, "\u3000"), (14, "Bako flow résumé 12 fix!"), (15, "x\r\ny"), (16, "x\ny"), (17, "x²"), (18, "x2"), (19, "мир а"), (20, "мир a"),
    ]
    df = spark.createDataFrame([(*x, 0) for x in data], "doc_id long, text string, look int")
    got = pairs(visual.same_look_pairs(df))
    same = {1, 2, 3, 4, 5, 9}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(same), 2) if (a, b) != (1, 9)} | {(19, 20)}
    forms = {r["key"]: r["consistent"] for r in visual.normalized(df).collect()}
    assert len({forms[i] for i in same}) == 1 and forms[10] is None and forms[11] == ""
    assert visual.same_look_pairs(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_stable(text):
    once = visual.same_look(text)
    assert visual.same_look(once) == once
    assert visual.consistent(visual.consistent(text)) == visual.consistent(text)


LOOKS = [c for c in visual.FIXED] + list("abnvyuilABNVYUIL éŉ²ﬁΆάΰﾠＡ\u0301\u0308\u200b\u00a0\u3000\u00ad𝐀ᴬßẞİıſ")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(LOOKS), max_size=12), st.randoms(use_true_random=False))
def test_same_look_meets(text, r):
    """Whatever leaves the look as it is leaves the comparison form as it is."""
    own = visual.forms()
    back = defaultdict(list)
    for c, t in visual.FIXED.items():
        back[t].append(c)
    other = "".join(r.choice(back[c]) if c in back and r.random() < 0.5 else c for c in unicodedata.normalize(r.choice(["NFC", "NFD"]), own.same_look(text)))
    if own.same_look(other) == own.same_look(text):
        assert own.comparison(other) == own.comparison(text)


def test_look_alikes_of_all_scripts(spark):
    letters = visual.look_alikes(spark)
    assert {"Ꭺ": "A", "ꓮ": "A", "ⲟ": "o", "ɡ": "g", "ɑ": "a", "а": "a", "Ӏ": "I", "Ο": "O", "օ": "o"}.items() <= letters.items()
    assert all(t.isascii() and t.isalpha() for t in letters.values()) and not any(c.isascii() for c in letters)
    df = spark.createDataFrame([(1, "Apogee"), (2, "ꓮpoɡee"), (3, "apogee"), (4, "Ap\u2c9fgee")], "doc_id long, text string")
    assert pairs(visual.same_look_pairs(df)) == {(1, 2), (1, 4), (2, 4)}
