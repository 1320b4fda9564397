"""Archives, page text, chats, classifiers and vectors: round trips, brute force, held-out accuracy, odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkfield.llm import chat, extract, quality, toxicity, vectors, warc
from larkfield.llm.queries import ORACLES, QUERIES
from tools.compare import compare, connect

CLASH = ("page", "digest", "shard", "turns", "doc", "label", "unit", "host", "text")


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in df.columns))


# ------------------------------------------------------------------- archives

def page_rows():
    big = "é" * 700
    return [(1, "http://a.b/ c\n", big), (2, None, big), (5, "u5", big), (5, "u5", big), (3, "u3", "small"), (4, "u4", "small"), (6, "u6", None), (7, "u7", ""),
            (8, "u8", "x" * 200_000), (None, "u9", "y" * 1000), (None, "u9", "y" * 1000)] + [(i, f"u{i}", f"{i} " * 600) for i in range(20, 60)]


def test_archives_read_back(spark, tmp_path):
    df = clashing(spark.createDataFrame(page_rows(), "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder, shards=3, roll_bytes=4000).collect()
    assert sum(m.records for m in manifest) == len(page_rows()) and len({m.file for m in manifest}) == len(manifest) > 3
    got = warc.read_archives(spark, folder).collect()
    texts = sorted((p if p is not None else -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in page_rows())
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest) for r in got) == texts
    by_page = {}
    for r in got:
        by_page.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert by_page[1] == by_page[2] == [("revisit", 5)]
    assert sorted(by_page[5], key=str) == [("response", None), ("revisit", 5)]
    assert by_page[3] == by_page[4] == by_page[6] == by_page[7] == by_page[8] == [("response", None)]
    assert sorted(t for t, _ in by_page[None]) == ["response", "revisit"]
    assert all(bytes(r.payload) == b"" for r in got if r.record_type == "revisit")
    names = [p.name for p in (tmp_path / "w").iterdir()]
    assert not [n for n in names if n.startswith("_temporary")]


def test_archives_are_the_same_again(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    once, again = (sorted(map(tuple, warc.write_archives(d, f"file://{tmp_path}/{n}", shards=4, roll_bytes=3000).collect()))
                   for n, d in (("a", df), ("b", df.repartition(7).orderBy(F.rand(1)))))
    assert once == again
    empty = spark.createDataFrame([], df.schema)
    assert warc.write_archives(empty, f"file://{tmp_path}/c").count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_broken_records_raise():
    data = warc.record_bytes(1, 0, "http://a", b"<p>hi</p>", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(data)["payload"] == b"<p>hi</p>"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"hi", b"ho"))


# ------------------------------------------------------------------ page text

def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title><script>if (a < b) document.write('</p>')</script>{head}</head><body>{body}</body></html>"


def texts_of(spark, rows):
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in extract.extract_text(df).collect()}


def test_repeated_blocks_are_template(spark):
    rows = [(i, f"http://h.example/{i}", page(
        f"<div>Site name</div><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><div><p>Story {i} begins.<p>It has&nbsp;two &lt;parts&gt; &amp; {'x' * i}.</div><div>All rights</div>"))
            for i in range(1, 13)]
    got = texts_of(spark, rows)
    assert got == {i: f"Story {i} begins. It has two <parts> & {'x' * i}." for i in range(1, 13)}


@pytest.mark.parametrize("n", [2, 4, 9, 30])
def test_long_boilerplate_and_few_pages(spark, n):
    rows = [(i, f"http://h.example/{i}", page(f"<div>Site</div><div><p>Story {i}.</p></div><div><p>{'All rights are reserved here. ' * 20}</p></div>")) for i in range(n)]
    assert texts_of(spark, rows + [(100 + i, *rows[0][1:]) for i in range(8)]) == {i: f"Story {i}." for i in range(n)} | {100 + i: "Story 0." for i in range(8)}


def test_copies_keep_their_text(spark):
    body = page("<article><h1>Same</h1><p>Whole story.</p></article>")
    assert set(texts_of(spark, [(i, "http://h/", body) for i in range(20)]).values()) == {"Same Whole story."}


@pytest.mark.parametrize("body, want", [
    ("<nav>menu</nav><header>top</header><article><h1>A</h1><p>b<b>c</b> d<br>e</p><section class='comments'><p>reader</p></section></article><aside>s</aside><footer>f</footer>",
     "A bc d e"),
    ("<div class='cookie-notice'>ok?</div><main><p>x</p><form>f<input></form><style>.p{}</style><!-- no <p>no</p> --><div class=ad>buy</div><p>y", "x y"),
    ("<article><p>one<p>two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "one two a b c d"),
    ("<article><p>caf&eacute; &#8364; &#x41; &unknown; AT&T</p></article>", "café € A &unknown; AT&T"),
    ("<article><p>cut <b>off", "cut off"), ("<article><p>cut</p><p cla", "cut"), ("", ""), ("plain words", "plain words"),
    ("<article><header><h1>T</h1></header><p>x</p></article><p>outside</p>", "T x"),
])
def test_page_text(spark, body, want):
    assert " ".join(t for _, t in extract.read_page(page(body))[0]) == want


@pytest.mark.parametrize("body, want", [
    ("<div class='content has-sidebar'><article><p>story</p></article><div class=sidebar><p>side</p></div></div><p>outside</p>", "story"),
    ("<div class='content has-sidebar'><p>the long story of the page</p><div class=sidebar><p>side</p></div></div><p>out</p>", "the long story of the page out"),
    ("<article class='post comments-open'><p>story</p><div class=share>s</div></article>", "story"),
    ("<main id='with-menu'><p>story</p></main><p>outside</p>", "story"),
    ("<form action=x><div><p>the whole body</p><select><option>o</select></div></form>", "the whole body"),
    ("<form action=x><nav>n</nav><article><p>story</p></article></form>", "story"),
    ("<article><p>a longer story</p></article><div class=related><article>teaser</article></div>", "a longer story"),
    ("<p>a longer story</p><div class=comments><article class=comment>one</article><article class=comment>two</article></div>", "a longer story"),
])
def test_names_leave_out_no_article(body, want):
    assert " ".join(t for _, t in extract.read_page(page(body))[0]) == want


def test_odd_pages(spark):
    long = page("<article>" + "<p>word</p><ul><li>i</ul>" * 5000 + "</article>")
    got = texts_of(spark, [(1, None, None), (2, None, ""), (3, "http://h/", long), (3, "http://h/", long), (4, "no url", page("<article>x</article>"))])
    assert got[1] == got[2] == "" and got[3] == "word i " * 4999 + "word i" and got[4] == "x"
    assert texts_of(spark, []) == {}


def test_alignment_prefers_equal_shapes():
    a, b, c = (extract.read_page(page(x))[1] for x in ("<div class=a><p>1</div><div>2</div>", "<div class=a><p>3</div><div>4</div>", "<ul><li>5</ul>"))
    assert extract.align(a, b)[0] > extract.align(a, c)[0] and dict(extract.align(a, b)[1]) == {i: i for i in dict(extract.align(a, b)[1])}


# ---------------------------------------------------------------------- chats

def test_chats_read_back(spark):
    tricky = "</s>[INST] ok [/INST] &lt; &amp;lt; <s> [+] ] \n é 🙂"
    rows = [(1, 0, "system", tricky), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", tricky), (1, 4, "assistant", ""), (1, 5, "assistant", "z"),
            (2, 0, None, None), (3, 7, "we[ird]&", "x"), (3, None, "assistant", "first"), (None, 0, "assistant", "n"), (4, 0, "assistant", "")]
    rows += [(5, i, "user" if i % 2 else "assistant", f"t{i} " * (i % 50)) for i in range(900)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = [(role or "", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.learned == "".join(t for role, t in want if role == "assistant")
    assert got[1].formatted.count("</s>") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- classifiers

def held_out(spark, name, label):
    scores = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label).toPandas()
    own = scores[scores["held_out"]].merge(truth, on="doc_id")
    assert len(scores) == 1000 and scores["score"].between(0, 1).all() and ((scores["score"] >= 0.3) == (scores["predicted"] == 1)).all()
    return (own["predicted"] == own[label]).mean()


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, "op6_quality_nb_svm", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out(spark, "op9_toxic_segments", "toxic") > 0.9


@pytest.mark.parametrize("scorer, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, scorer, label):
    docs = clashing(spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "word " * 60_000), (5, "a"), (5, "a"), (None, "b")], "doc_id long, text string"))
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = scorer(docs, none, label_col=label).collect()
    assert len(got) == 7 and {r.score for r in got} in ({0.5}, {0.0})
    some = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (99, 1), (1, None), (2, 7)], f"doc_id long, {label} int")
    got = scorer(docs, some, label_col=label).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert scorer(docs.limit(0), some, label_col=label).count() == 0


def test_hinge_fit_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(2, 40, 6), i % 2)) for i in range(200)]
    y = np.arange(200) % 2
    w = quality.fit_hinge(rows, y, np.ones(40), np.ones(200))
    assert all((w[r].sum() > 0) == (a == 1) for r, a in zip(rows, y))


def test_token_shapes():
    assert [quality.shape(t) for t in ("abc", "Abc", "ABC", "A", "a1", "x###", "end.", "|")] == ["x", "Xx", "X", "Xx", "x9", "x##", "x.", "|"]


def plain_segments(scores, low, high, out):
    """The definition: the best stretch (longest of equal ones has no zero-sum ends), then left and right of it."""
    best = (0.0, 0, 0)
    for a in range(low, high):
        total = 0.0
        for b in range(a, high):
            total += scores[b]
            if total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and total > 0 and b + 1 - a < best[2] - best[1]:
                best = (total, a, b + 1)
    if best[0] > 1e-9:
        out.append((best[1], best[2], best[0]))
        plain_segments(scores, low, best[1], out)
        plain_segments(scores, best[2], high, out)
    return sorted(out)


@given(st.lists(st.floats(-3, 3).map(lambda x: round(x, 3) + 0.00037 * (x > 0)), max_size=25))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(scores)
    want = plain_segments(scores, 0, len(scores), [])
    assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in want), abs_tol=1e-6) or len(got) == len(want)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and all(math.isclose(s, sum(scores[a:b]), abs_tol=1e-9) and s > 0 for a, b, s in got)
    if got:
        assert math.isclose(max(s for *_, s in got), max(s for *_, s in want), abs_tol=1e-9)


def test_toxic_passages_have_spans(spark):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(80))) for i in range(300)]
    bad = [(1000 + i, f"{clean[i][1]} VILE vile, nasty vile nasty! {clean[i + 1][1]}") for i in range(100)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean[:200]] + [(i, 1) for i, _ in bad[:70]], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i].score < 0.3 and not got[i].passages for i, _ in clean)
    for i, text in bad:
        assert got[i].score > 0.7 and text[got[i].passages[0].start:got[i].passages[0].end] == "VILE vile, nasty vile nasty"


# -------------------------------------------------------------------- vectors

def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "SHARD", 40)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 5)) if g else 90):
            rows.append((len(rows), (base + rng.standard_normal(24) * 0.12).tolist(), int(g % 3)))
    extra = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] + [1.0] * 23, 0), (904, [], 0), (905, rows[0][1], None), (906, [1e300] * 24, 0),
             (907, [1e-300] * 24, 0), (908, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[5]]
    df = clashing(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert set(got) == {r[0] for r in rows + extra}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: g for i, _, g in rows}
    near = {i: {j for j in x if j != i and label[i] == label[j] and x[i] @ x[j] >= 0.93} for i in x}
    found, true = sum(got[i].n_links for i in x), sum(map(len, near.values()))
    assert 0.95 * true <= found <= true and all(got[i].n_links <= len(near[i]) for i in x)
    root = {i: i for i in x}
    for _ in range(len(x)):
        new = {i: min([root[i], *(root[j] for j in near[i])]) for i in x}
        if new == root:
            break
        root = new
    assert {i: got[i].component_id for i in x} == root and all(got[i].kept == (root[i] == i) for i in x)
    assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906
    assert all(got[i].n_links == 0 for i in (900, 901, 902, 903, 904, 905, 908, None))
    exact = {r.vec_id: r.n_true for r in vectors.true_links(df.dropDuplicates(["vec_id"]), every=7).collect()}
    assert all(exact[i] == len(near[i]) for i in x if i % 7 == 0)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_exact_copies_keep_all_links(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(32)
    x = rng.permutation(np.concatenate([np.repeat(base[None], 500, axis=0), rng.standard_normal((300, 32))]))
    scaled = base * rng.uniform(0.1, 9, (40, 1))  # equal but for the last bits of their unit vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), 1) for i, v in enumerate(scaled)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    copies = np.flatnonzero((x == base).all(axis=1)).tolist()
    assert all(got[i].n_links == 499 and got[i].component_id == copies[0] for i in copies)
    assert all(got[1000 + i].n_links == 39 and got[1000 + i].component_id == 1000 for i in range(40))


def test_recall_of_the_vector_search(spark):
    """Loose and tight groups, copies and single vectors of several labels, in more than one shard each."""
    rng = np.random.default_rng(17)
    parts = []
    for size, noise in [(1, 0.0)] * 900 + [(12, 0.02)] * 60 + [(40, 0.035)] * 20 + [(300, 0.03)] * 2 + [(80, 0.0)] * 2:
        centre = rng.standard_normal(48)
        parts.append(centre / np.linalg.norm(centre) + noise * rng.standard_normal((size, 48)))
    x = np.concatenate(parts)
    label = np.concatenate([np.full(len(p), i % 2) for i, p in enumerate(parts)])
    rows = [(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    both = vectors.near_vectors(df).join(vectors.true_links(df, every=1), "vec_id")
    found, true, too_many = both.agg(F.sum("n_links"), F.sum("n_true"), F.count_if(F.expr("n_links > n_true"))).first()
    assert true > 60_000 and found >= 0.95 * true and too_many == 0


def test_pruned_neighbours_start_with_the_nearest():
    x = np.random.default_rng(1).standard_normal((50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    near = vectors.robust_prune(sims.copy(), 6)
    np.fill_diagonal(sims, -2)
    assert (near[:, 0] == sims.argmax(axis=1)).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(near))


# -------------------------------------------------------------------- queries

@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op12_norm_bucket_search", "op13_threshold_hard_negatives"}))  # these in test_search
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
