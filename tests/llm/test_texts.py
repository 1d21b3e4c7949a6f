"""Sentences, languages, boilerplate, residue, splitting, packing and percentiles."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.llm import p01_boilerplate as p1
from passagemill.llm import p03_sentences as p3
from passagemill.llm import p04_language as p4
from passagemill.llm import p05_percentiles as p5
from passagemill.llm import p07_split as p7
from passagemill.llm import p08_packing as p8
from passagemill.llm import p10_residue as p10

from .tables import DAY, passages, write

EN = ["The old mill stands near the river.", "Dr. Smith visited the mill in May.", "A boat carries approx. 40 people to the island.", "It costs $4.99 per person.", "Nobody knew why the gate was closed!", "Was the bridge built in 1920?"]
HI = ["यह पुराना घर नदी के पास है।", "डॉ. शर्मा शहर में रहते हैं।", "बाज़ार में चावल रु. 250 का मिलता है।", "क्या वह स्कूल गया था?", "लड़का पानी पीता है।"]
MR = ["हे जुने घर नदीजवळ आहे.", "डॉ. पाटील शहरात राहतात.", "शाळा सकाळी सुरू होते.", "तांदूळ रु. 40 ला मिळतो.", "मुले मैदानात खेळतात."]


def _mix(r, pool, n):
    return " ".join(r.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def boundaries():
    r = random.Random(1)
    return p3.train(["\n\n".join(_mix(r, pool, r.randrange(1, 5)) for _ in range(4)) for pool in (EN, HI, MR) for _ in range(150)])


def cut(text, model):
    out, at = [], 0
    for e in p3.sentence_ends(text, model):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith visited the mill in May. The old mill stands near the river.", 2),
        ("It costs $4.99 per person. The gate was closed.", 2),
        ("The old mill... stands near the river.", 1),
        ("“Nobody knew why the gate was closed!” asked the boat near the river.", 1),
        ("1. The old mill stands near the river. 2. A boat carries people to the island.", 2),
        ("The old mill stands near the river.A boat carries people to the island.", 2),
        ("The old mill stands\nnear the river.\n\nIt costs money", 2),
        ("“यह पुराना घर नदी के पास है?”, शर्मा कहते हैं। लड़का पानी पीता है।", 2),
        ("डॉ. शर्मा शहर में रहते हैं।लड़का पानी पीता है।", 2),
        ("(The old mill stands near the river.) It costs money.", 2),
        ("Was the bridge built in 1920?! \"The gate was closed.\"  ", 2),
        ("", 0), ("  \n ", 0), ("no mark at all", 1),
    ],
)
def test_sentences(boundaries, text, want):
    assert len(cut(text, boundaries)) == want


@given(st.text(alphabet="ab .!?।\n\"'”(1A,", max_size=60))
@settings(max_examples=200, deadline=None)
def test_sentence_offsets(boundaries, text):
    ends = p3.sentence_ends(text, boundaries)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)
    assert not text[ends[-1] :].strip() if ends else not text.strip()


def test_languages(boundaries):
    r = random.Random(2)
    rows = [(_mix(r, pool, 4), lang) for pool, lang in ((EN, "en"), (HI, "hi"), (MR, "mr")) for _ in range(60)]
    rows += [(_mix(r, HI, 4), "mr")] * 5 + [(_mix(r, EN, 4), "hi")] * 5  # wrong labels
    model = p4.train(rows, boundaries)
    langs = lambda t: [p4.LANGUAGES[s[3]] for s in p4.segments(t, p3.sentence_ends(t, boundaries), model)]
    assert langs(_mix(r, HI, 3)) == ["hi"] and langs(_mix(r, MR, 3)) == ["mr"]
    assert langs(_mix(r, HI, 3) + " " + _mix(r, EN, 3) + "\n\n" + _mix(r, HI, 2)) == ["hi", "en", "hi"]
    assert langs(_mix(r, HI, 3) + " " + _mix(r, MR, 3)) == ["hi", "mr"]
    assert langs("यह पुराना “old mill” नदी के पास है। लड़का पानी पीता है।") == ["hi"]
    assert langs("यह पुराना घर है। " + "x" * 400 + " लड़का पानी पीता है।") == ["hi"]
    assert langs("") == [] and langs("12 34.") == []


def test_boilerplate(spark, tmp_path):
    r = random.Random(3)
    rows, want = [], set()
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    for i in range(60):
        host = ["a-mill.example", "b-gate.example", None][i % 3]
        nav = "Home · Search · Careers" if i % 3 == 0 else "- Home\n- Search"
        body = ["Overview"] if i % 2 else []
        body += [f"{r.choice(EN)} The {word()} of the {word()} is a {word()} near {i} {word()}.", f"Depth: {i}.5 m", "• " + f"The {word()} carries {word()} and {i} {word()} to the island."]
        lines = nav.split("\n") + body + ["", "Advertisement", f"» Uses of the item {i}", "Related articles", f"Last edited by user{i} | Report a problem", "Sign up for our weekly letter and never miss an update!"]
        if i % 3 == 1:
            lines.insert(len(nav.split("\n")) + len(body) - 1, "Advertisement")
        rows.append({"raw_text": "\n".join(lines), "site": host, "origin": "page"})
        keep = set(body)
        want |= {("passage_occurrence", i + 1, n) for n, x in enumerate(lines) if x and x not in keep}
    d = write(tmp_path, passage_occurrence=passages(rows), chunk=[dict(chunk_id=5, parent_passage_id="p1", text="Home · Search · Careers\nThe boat of the mill carries people over.")])
    got = {tuple(x) for x in p1.found(spark, d).collect()}
    assert ("chunk", 5, 0) in got and ("chunk", 5, 1) not in got
    got = {x for x in got if x[0] != "chunk"}
    missed = sorted((rows[i - 1]["raw_text"].split("\n")[n], rows[i - 1]["site"]) for _, i, n in want - got)
    assert not missed[:5], missed[:5]
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def _host_pages(r, n, lines, site):
    """n pages of a host: a sentence of the page's own, then what lines(i) gives."""
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    return [{"raw_text": "\n".join([" ".join(word() for _ in range(12)) + ".", *lines(i)]), "site": site, "origin": "page"} for i in range(n)]


def test_boilerplate_by_share_of_host(spark, tmp_path):
    """A sentence that one page of each of many hosts holds is body, a small host's own notice is frame, and chunks of a page don't vote beside it."""
    r = random.Random(11)
    founded, notice, chunked = "It was founded in 1850.", "This text may be copied for the use of the parish and for nothing else.", "The bridge was built twice."
    rows = [x for k in range(8) for x in _host_pages(r, 30, lambda i: [founded] if i == 0 else [], f"h{k}-mill.example")]
    rows += _host_pages(r, 4, lambda i: [notice], "s-gate.example")
    rows += _host_pages(r, 3, lambda i: [chunked] if i == 0 else [], "c-barn.example")
    chunks = [dict(chunk_id=k, parent_passage_id=f"p{len(rows) - 2}", text=f"{rows[-3]['raw_text'][5 * k:]}") for k in range(1, 4)]
    d = write(tmp_path, passage_occurrence=passages(rows), chunk=[c for c in chunks])
    got = {tuple(x) for x in p1.found(spark, d).collect()}
    assert got == {("passage_occurrence", i + 1, 1) for i, x in enumerate(rows) if x["site"] == "s-gate.example"}


def test_boilerplate_of_rare_words(spark, tmp_path):
    """A menu word on three pages is frame, whatever number of words is more frequent."""
    r = random.Random(12)
    menu = "\n".join(f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(1600))
    own = [x["raw_text"] for x in _host_pages(r, 8, lambda i: [], None)]
    rows = [{"raw_text": f"Home\n{'velu karam' if i < 3 else menu}\n{x}", "site": "a-mill.example", "origin": "page"} for i, x in enumerate(own)]
    d = write(tmp_path, passage_occurrence=passages(rows))
    got = {(i, n) for _, i, n in p1.found(spark, d).collect()}
    assert {x for x in got if x[0] <= 3} == {(i, n) for i in (1, 2, 3) for n in (0, 1)}


@pytest.mark.parametrize(
    "text,case",
    [
        ("404 Not Found\nThe page you asked for does not exist on Mill Gate.\nRequest 7a0bc40c11 at 10:12", True),
        ("Home · Search\nPlease enable JavaScript to view this page.\n© 2020 Mill Gate. All rights reserved.", True),
        ("null\nundefined\n[object Object]", True),
        ("Lorem ipsum dolor sit amet. Dolor amet ipsum lorem.", True),
        ("The old {{ title }} stands near the river and nobody knew why.", True),
        ("यह पुराना ${price} नदी के पास है।", True),
        ("The manual explains that a mark such as {{ title }} is replaced by the heading before the page is sent, so no reader sees it.", False),
        ("The setting ${HOME} names the folder of the user, wrote the clerk in the guide to the mill.", False),
        ("The old mill stands near the river and nobody knew why it closed. Please enable JavaScript to post a comment.", False),
        ("When a reader in Mill met error 404, the gate office learned that an address had no page behind it.", False),
        ("The old mill stands near the river.", False), ("", False), (None, False),
    ],
)
def test_residue(text, case):
    df = {w: 5 for w in p10.vocabulary()} | {w: 700 for w in "the of a in to is and it that was for on this page be by no you your not are an".split()}
    assert p10.judge(text, p10.Exemplars(df, 1000))[0] is case


@given(st.text(alphabet=st.sampled_from("ab. \n।िक"), max_size=400), st.integers(20, 60), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_split_is_whole(text, limit, overlap):
    pieces = p7.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in pieces) == text
    assert all(e - a <= limit and b - a <= overlap for a, b, e in pieces)


def test_split_at_sentences():
    text = " ".join(f"Sentence number {i} of the mill is here." for i in range(60))
    pieces = p7.split_text(text)
    assert all(text[:e].rstrip().endswith(".") for _, _, e in pieces) and len(pieces) > 3
    with pytest.raises(ValueError):
        p7.split_text("x", 10, 10)


def test_pieces_are_numbered(spark, tmp_path):
    d = write(tmp_path, chunk=[dict(chunk_id=i, parent_passage_id="p", chunk_strategy="s", chunk_strategy_version="v", chunk_ordinal=i, text="word " * n) for i, n in enumerate([10, 400, 1, 300])])
    rows = sorted(p7.pieces(spark, d).collect(), key=lambda r: r.chunk_ordinal)
    assert [r.chunk_ordinal for r in rows] == list(range(len(rows))) and {r.chunk_total for r in rows} == {len(rows)}
    assert [r.chunk_id for r in rows] == sorted(r.chunk_id for r in rows)


def test_packing():
    r = random.Random(6)
    items = [(i, r.choice(["a", "a", "b", "c", None]), r.choice([r.randrange(1, 900), r.randrange(1, 3000), 9000])) for i in range(3000)]
    share = defaultdict(float)
    for _, s, n in items:
        share[s] += n
    share = {s: v / sum(share.values()) for s, v in share.items()}
    rows = p8.pack(items, share, {})
    used, parts, windows = defaultdict(int), defaultdict(list), defaultdict(lambda: defaultdict(int))
    for c, w, doc, piece, a, b, s in rows:
        used[c] += b - a
        parts[doc].append((piece, a, b))
        windows[w][s] += b - a
    assert max(used.values()) <= p8.CAPACITY and sum(used.values()) / (len(used) * p8.CAPACITY) > 0.97
    for doc, _, n in items:
        p = sorted(parts[doc])
        assert p[0][1] == 0 and p[-1][2] == n and all(x[2] == y[1] for x, y in zip(p, p[1:])) and (len(p) == 1 or n > p8.CAPACITY)
    middle = windows[len(windows) // 2]
    assert all(abs(middle[s] / sum(middle.values()) - v) < 0.25 for s, v in share.items())


def test_packing_spark(spark, tmp_path, monkeypatch):
    d = write(tmp_path, documents=[dict(doc_id=i, text="water mill " * (i % 40 + 1), source="hot" if i % 3 else f"s{i % 7}") for i in range(400)])
    monkeypatch.setattr(p8, "PACKER_TOKENS", 9000)
    rows = p8.assignments(spark, d).collect()
    sizes = {r.doc_id: r.n_tokens for r in p8.token_counts(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == sizes and len(rows) == 400


@pytest.mark.parametrize("values", [np.random.default_rng(1).lognormal(5, 2, 60_000), np.random.default_rng(2).integers(0, 5, 20_000).astype(float), np.full(5000, 3.0), np.arange(7.0)])
def test_digests_merge_within_bound(values):
    parts = [p5.cluster(v, np.ones(len(v))) for v in np.array_split(values, 13)]
    m, w = p5.cluster(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
    assert w.sum() == len(values)
    for q, e in zip(p5.QUANTILES, p5.estimate(m, w, values.min(), values.max())):
        below, upto = (values < e).mean(), (values <= e).mean()
        assert below - p5.BOUND <= q <= upto + p5.BOUND


def test_percentiles(spark, tmp_path):
    r = random.Random(8)
    rows = [dict(request_id=f"r{i}", language=r.choice(["en", "hi", None]), decision="allow", total_backend_ms=r.expovariate(0.01), stages_ms=[("rerank", r.random())], sampled_at=DAY, received_at=DAY) for i in range(3000)]
    d = write(tmp_path, latency_sample=rows + rows[:100])
    got = {(x.metric, x.language): x for x in p5.percentiles(spark, d).filter("grain = 'all'").collect()}
    assert sum(x.n for (m, _), x in got.items() if m == "rerank") == 3000
    v = np.sort([x["total_backend_ms"] for x in rows if x["language"] == "en"])
    x = got["total_backend_ms", "en"]
    assert x.n == len(v) and x.within_bound and abs(np.searchsorted(v, x.p95) / len(v) - 0.95) <= p5.BOUND


def test_windows_keep_a_mixture():
    """Unequal supply, stated shares: every window but the last ones holds them up to one text, and carried deficits even them out."""
    from passagemill.llm.p08_packing import pack

    r = random.Random(8)
    supply = {"a": 4000, "b": 1500, "c": 900}
    items, k = [], 0
    for s, n in supply.items():
        for _ in range(n):
            items.append((k := k + 1, s, r.randrange(20, 700)))
    share = {"a": 0.6, "b": 0.25, "c": 0.15}
    rows = pack(items, share, {}, 2048, 32)
    assert sorted({(d, e) for _, _, d, _, _, e, _ in rows}) == sorted((d, n) for d, _, n in items)
    of: dict = {}
    for _, w, _, _, b, e, s in rows:
        of.setdefault(w, {}).setdefault(s, 0)
        of[w][s] += e - b
    live = min(max(w for w in of if s in of[w]) for s in supply)  # from here on a source has run out
    assert live > 5
    total = dict.fromkeys(supply, 0)
    for w in range(live):
        for s, x in share.items():
            total[s] += of[w].get(s, 0)
            assert abs(total[s] - x * 2048 * 32 * (w + 1)) < 700


def test_spaced_seeds_catch_substitutions():
    """Where every eighth word differs no ten words in a row are equal; the masks with gaps find the stretch, the full mask alone does not."""
    from passagemill.llm import p09_leaks as P

    item = " ".join(f"w{i}" for i in range(40))
    text = " ".join(f"w{i}" if i % 9 else f"x{i}" for i in range(40))
    table = P.Items([(1, item)])
    assert [x[3] >= 2 * P.WINDOW and x[2] < P.WINDOW for x in table.search([P.number(text, table.vocab)])] == [True]
    table.tables = table.tables[:1]
    assert table.search([P.number(text, table.vocab)]) == []


def test_main_text(spark, tmp_path):
    """The body of a page comes out as it stands, and is empty for a page without body or lines."""
    from passagemill.llm import p01_boilerplate as P

    body = "The old mill stands by the river and grinds corn for the village."
    rows = passages([{"raw_text": t, "origin": "page"} for t in (f"Home | About | Search\n\n{body}\r\n\nHome | Terms | Privacy", None, "", "Home | About | Search")])
    got = {r.row_id: (r.main_text, r.body_lines) for r in P.main_text(spark, write(tmp_path, passage_occurrence=rows)).collect()}
    assert got == {1: (body + "\r", 1), 2: ("", 0), 3: ("", 0), 4: ("", 0)}
