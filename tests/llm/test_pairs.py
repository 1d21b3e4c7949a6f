"""Near-equal texts, overlaps between splits, history and leaks against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.llm import near, p02_overlap, p06_history, p09_leaks
from passagemill.llm.words import edit_distance_within, gram_hashes, word_ids, words

from .tables import passages, write


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_words_ignore_form():
    assert words("The  CAT’s​ “hat”,\r\n été!") == words("the cats hat été")
    assert words(" — … ") == [] and words(None) == []


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.integers(0, 8))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b, most):
    x, y = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
    assert edit_distance_within(x, y, most) == min(levenshtein(a, b), most + 1)


@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=9), min_size=1, max_size=6, unique_by=tuple), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=9), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_full_text_index(texts, queries):
    """Every run is found at each of its places, before and after a round trip, and the texts come back."""
    t = [np.array(x, dtype=np.uint32) for x in texts]
    for index in (ix := p02_overlap.FullTextIndex.of(t), p02_overlap.FullTextIndex.from_bytes(ix.to_bytes())):
        assert [x.tolist() for x in index.texts(np.arange(len(t))[::-1])] == texts[::-1]
        for q in queries:
            for length in (1, 2, 3):
                begin, lo, hi = index.runs(index.code(np.array(q, dtype=np.uint32)), length)
                got = {(b, w) for b, x, y in zip(begin.tolist(), lo, hi) for w in index.locate(np.arange(x, y)).tolist()}
                want = {(i, s + j) for i in range(len(q) - length + 1) for x, s in zip(texts, index.starts.tolist()) for j in range(len(x) - length + 1) if q[i : i + length] == x[j : j + length]}
                assert got == want


def edited(r, w, share):
    w = list(w)
    for _ in range(int(len(w) * share)):
        k, what = r.randrange(len(w)), r.randrange(3)
        if what == 0 and len(w) > 4:
            w.pop(k)
        elif what == 1:
            w[k] = f"new{r.randrange(999)}"
        else:
            w.insert(k, f"new{r.randrange(999)}")
    return w


def corpus(seed, n):
    """Texts of 6 to 120 words with copies, edited copies at several rates, and phrases that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(6, 120))] for _ in range(n)]
    for b in base[::3]:
        b[2:2] = "home to many people it was built around a search for water".split()
    out = [list(b) for b in base]
    out += [edited(r, r.choice(base), r.choice([0, 0.04, 0.1, 0.16, 0.3, 0.5])) for _ in range(n)]
    r.shuffle(out)
    return r, [" ".join(w) for w in out]


def near_equal(a, b):
    a, b = word_ids(a), word_ids(b)
    most = max(len(a), len(b)) // 6
    return edit_distance_within(a, b, most) <= most


@pytest.mark.parametrize("shard_words, routed", [(4_000_000, 8), (700, 100), (700, 0)])
def test_overlap_of_splits(spark, tmp_path, monkeypatch, shard_words, routed):
    """Rows and links against brute force: one shard, many shards, and many with routing."""
    monkeypatch.setattr(p02_overlap.overlaps, "__defaults__", (shard_words, routed))
    monkeypatch.setattr(p02_overlap, "LEAST_PART", 2000)
    r, texts = corpus(1, 120)
    texts += ["a b", "c", "d e f", "a b c d", "a b c d x"] * 2
    rows = passages([{"raw_text": t, "split": r.choice(["train", "TRAIN", "val", "Validation"]), "config_language": "hi"} for t in texts])
    d = write(tmp_path, passage_occurrence=rows, eval_example=[dict(query_id=7, candidates_en=[texts[0].upper(), "no such text at all here", "a b"])])
    train = [x["raw_text"] for x in rows if x["split"].lower().startswith("tr")]
    want = {("occurrence", x["occurrence_id"], x["passage_position"]) for x in rows if x["split"].lower().startswith("val") and any(near_equal(x["raw_text"], t) for t in train)}
    want |= {("candidate", 7, i) for i, t in enumerate([texts[0], "", "a b"]) if t and any(near_equal(t, x) for x in train)}
    got = {tuple(x) for x in p02_overlap.found(spark, d).collect()}
    assert got == want and len(want) > 20
    held = [x["raw_text"] for x in rows if x["split"].lower().startswith("val")] + [texts[0], "a b"]
    key = lambda t: xxhash.xxh3_128_hexdigest(word_ids(t).tobytes()).upper()
    pairs = {(key(a), key(b)) for a in held for b in train if near_equal(a, b)}
    links = p02_overlap.links(spark, d).collect()
    assert {(x["class"], x.partner) for x in links} == pairs and len(links) == len(pairs)
    size = {key(t): len(words(t)) for t in held}
    assert all(x.covered == x.longest == size[x["class"]] and x.spans == 1 for x in links if x.edits == 0 and size[x["class"]] > 2)
    assert all(0 <= x.longest <= x.covered <= size[x["class"]] for x in links)
    report = p02_overlap.report(spark, d).collect()
    assert sum(x.rows_exact + x.rows_near for x in report if x.split != "train") == len(want) and sum(x.rows_all for x in report) == len(rows) + 3


def test_spans_merge():
    q, t = "one two three four five six seven eight nine ten eleven twelve".split(), "one two three four five XXX seven eight nine ten eleven twelve".split()
    ids = [word_ids(" ".join(x)) for x in (q, t)]
    got = p02_overlap.Stream(p02_overlap.FullTextIndex.of([ids[1]]), np.array([near.signature_of(ids[1])])).pairs([ids[0]])
    assert got[["edits", "spans", "covered", "longest"]].values.tolist() == [[1, 2, 11, 6]]


def test_history(spark, tmp_path):
    r, texts = corpus(2, 120)
    rows = passages([{"raw_text": t, "batch_no": r.randrange(5)} for t in texts])
    for x in rows:
        x["normalized_text"] = x["raw_text"]
    old = p06_history.normal_hash(rows[5]["raw_text"])
    rows[5]["batch_no"] = 2
    d = write(tmp_path, passage_occurrence=rows, seen_hashes=[dict(content_hash=old, first_passage_id="gone"), dict(content_hash=p06_history.normal_hash(rows[6]["raw_text"]), first_passage_id="p7")])
    want = {}
    for x in rows:
        if not x["batch_no"]:
            continue
        hits = [(y["batch_no"], y["occurrence_id"], y["passage_id"]) for y in rows if y["batch_no"] < x["batch_no"] and near_equal(x["raw_text"], y["raw_text"])]
        if p06_history.normal_hash(x["raw_text"]) == old:
            want[x["occurrence_id"]] = "gone"
        elif hits:
            want[x["occurrence_id"]] = min(hits)[2]
    got = {a: b for a, b in p06_history.found(spark, d).collect()}
    assert got == want and len(want) > 20
    top = {a: b for a, b in p06_history.representatives(spark, d).collect()}
    assert len(top) == len(rows) and set(top.values()) <= {x["passage_id"] for x in rows}


def test_representatives_are_components(spark, tmp_path):
    """Near-equal texts of one batch, of batch 0 alone, and those that only a third text connects have one representative."""
    r, texts = corpus(9, 60)
    base = [f"v{i}" for i in range(30)]
    texts += [" ".join(base[:k] + ["other"] * 4 + base[k + 4 :]) for k in (0, 20)] + [" ".join(base)]
    rows = passages([{"raw_text": t, "batch_no": 0 if i >= len(texts) - 3 else r.randrange(3)} for i, t in enumerate(texts)])
    rows[-1]["batch_no"] = 1
    of = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            if near_equal(x["raw_text"], y["raw_text"]):
                a, b = of[i], of[j]
                of = [b if k == a else k for k in of]
    want = {x["occurrence_id"]: min((y["batch_no"], y["occurrence_id"], y["passage_id"]) for y, k in zip(rows, of) if k == of[i])[2] for i, x in enumerate(rows)}
    assert want[len(rows)] == want[len(rows) - 1] == want[len(rows) - 2] == f"p{len(rows) - 2}"
    d = write(tmp_path, passage_occurrence=rows)
    assert {a: b for a, b in p06_history.representatives(spark, d).collect()} == want


def open_history(spark, d):
    return p06_history.History(spark, f"file://{d}/history", 4)


def accept(spark, history, batch, texts, first=1):
    rows = spark.createDataFrame([(first + i, f"p{first + i}", None, t) for i, t in enumerate(texts)], "occurrence_id bigint, passage_id string, hash string, text string")
    return {r.occurrence_id: r.m and (r.m.passage, r.m.kind) for r in history.accept(rows, batch).collect()}


def test_history_is_kept(spark, tmp_path):
    """Another session's history answers the next batch; a crashed attempt leaves nothing; a batch that comes again is a batch of copies."""
    a, b = " ".join(f"w{i}" for i in range(24)), " ".join(f"u{i}" for i in range(24))
    h = open_history(spark, tmp_path)
    assert accept(spark, h, 0, [a, a.upper(), None, ""]) == {1: None, 2: None, 3: None, 4: None}
    h.close()
    h = open_history(spark, tmp_path)
    crash = h._merge
    h._merge = lambda *x: 1 / 0
    with pytest.raises(ZeroDivisionError):
        accept(spark, h, 1, [b], 10)
    h._merge = crash
    assert h.read("classes").count() == 1 and accept(spark, h, 1, [b, a.replace("w5 ", "")], 10) == {10: None, 11: ("p1", "near")}
    h.close()
    h = open_history(spark, tmp_path)
    assert accept(spark, h, 2, [b, b.replace("u7", "x"), a.replace("w9", "x")], 20) == {20: ("p10", "exact"), 21: ("p10", "near"), 22: ("p1", "near")}
    top = {r["class"]: r["root"]["first_occurrence"] for r in h.roots(h.read("classes").select("class", F.struct("first_batch", "first_occurrence", "class").alias("first"))).collect()}
    assert sorted(top.values()) == [1, 1, 1, 10, 10] and h.buckets == 4


def test_batch_moves_no_history(spark, tmp_path):
    """The accepted keys and classes are scanned where they lie: what a batch shuffles is its own."""
    r, texts = corpus(11, 40)
    h = open_history(spark, tmp_path)
    accept(spark, h, 0, texts)
    batch = spark.createDataFrame([(1, "p", texts[0])], "occurrence_id bigint, passage_id string, text string")
    with_tokens = near.with_classes(batch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = h.candidates(with_tokens, 0)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(plan) if "passagemill_keys" in x)
    depth, chain = len(plan[at]), []
    for x in plan[at::-1]:  # from the scan to the join that takes it
        inner = len(x) - len(x.lstrip(" :+-*"))
        if inner < depth:
            depth = inner
            chain.append(x)
        if "Join" in x:
            break
    assert "Bucketed: true" in plan[at] and "Join" in chain[-1] and not any("Exchange" in x for x in chain)


def test_merge_by_joins(spark, tmp_path, monkeypatch):
    """Clusters that joins connect are those that one task connects."""
    monkeypatch.setattr(p06_history, "LINKS_AT_ONCE", 0)
    test_representatives_are_components(spark, tmp_path)


def test_hot_seeds_meet_in_cells(spark, tmp_path, monkeypatch):
    """A third of all rows are edited copies of one text; hot seeds are cut into cells and no link is lost."""
    monkeypatch.setattr(p06_history, "HOT_ROWS", 16)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(edited(r, base, 0.05)) for _ in range(80)] + [" ".join(f"u{r.randrange(5000)}" for _ in range(50)) for _ in range(160)]
    rows = passages([{"raw_text": t, "batch_no": 1 if i % 2 else 0} for i, t in enumerate(texts)])
    d = write(tmp_path, passage_occurrence=rows)
    want = {x["occurrence_id"]: min((y["occurrence_id"], y["passage_id"]) for y in rows if y["batch_no"] == 0 and near_equal(x["raw_text"], y["raw_text"]))[1] for x in rows if x["batch_no"] and any(y["batch_no"] == 0 and near_equal(x["raw_text"], y["raw_text"]) for y in rows)}
    assert {a: b for a, b in p06_history.found(spark, d).collect()} == want and len(want) >= 39


def spread(w, every):
    """Every so many words one is changed, dropped, or another added, in turn."""
    out = []
    for i, x in enumerate(w):
        k = i // every % 3
        out += [x] if (i + 1) % every else [f"new{i}"] if k == 0 else [] if k == 1 else [x, f"new{i}"]
    return out


def test_seeds_lose_nothing_at_the_limit():
    """Near-equal texts of 2 to 1,000 words meet in a seed at an allowed place, with edits at random places or spread evenly, changes only or mixed."""
    r, pairs = random.Random(4), 0
    for n in [*range(2, 60), 120, 300, 600, 1000] * 3:
        w = [f"w{r.randrange(9999)}" for _ in range(n)]
        swap = [x if (i + 1) % 6 else "new" for i, x in enumerate(w)]
        for e in (edited(r, w, 1 / 6), edited(r, w, 1 / 7), spread(w, 6), spread(w, 7), swap):
            a, b = word_ids(" ".join(w)), word_ids(" ".join(e))
            most = max(len(a), len(b)) // 6
            if not len(b) or a.tobytes() == b.tobytes() or edit_distance_within(a, b, most) > most:
                continue
            pairs += 1
            for x, y in ((a, b), (b, a)):
                s, m = near.seeds_of(x), near.most_edits(len(x)) + 1
                place = [i * len(x) // m for i in range(m)]
                assert any(abs(k - p) <= most for g in near.probes_of(y) for k, h in enumerate(g.tolist()) for p, z in zip(place, s.tolist()) if h == z)
            apart = int(np.bitwise_count((near.signature_of(a) ^ near.signature_of(b)).view(np.uint64)).sum())
            assert apart <= 2 * most and near.word_counts_allow([a.tobytes()], [b.tobytes()]).all()
            weights = np.array([-6.0, 6.0, 6.0, -6.0, 0.5, 0.5])
            assert weights @ np.array(p06_history.fields(a, b)) >= p06_history.least_score(weights, len(a), len(b))
    assert pairs > 500


def test_spread_edits_are_found(spark, tmp_path):
    """Texts with every sixth word changed are overlaps and repeats."""
    r = random.Random(6)
    base = [[f"w{r.randrange(3000)}" for _ in range(n)] for n in (12, 40, 60, 120, 300, 1000)]
    copies = [[x if (i + 1) % 6 else f"new{i}" for i, x in enumerate(w)] for w in base]
    rows = passages([{"raw_text": " ".join(w), "split": "train", "batch_no": 0} for w in base]) + [x | {"occurrence_id": 100 + i, "split": "val", "batch_no": 1} for i, x in enumerate(passages([" ".join(w) for w in copies]))]
    d = write(tmp_path, passage_occurrence=rows)
    assert {x.eval_id for x in p02_overlap.found(spark, d).collect()} == set(range(100, 106))
    assert {a: b for a, b in p06_history.found(spark, d).collect()} == {100 + i: f"p{i + 1}" for i in range(6)}


def test_leaks(spark, tmp_path):
    r = random.Random(5)
    items = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(10, 60))) for _ in range(40)]
    docs = []
    for i in range(120):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(3)):
            part = r.choice(items).split()
            a = r.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in part[a : a + r.randrange(6, 25)]]
        docs.append(" ".join(w))
    d = write(tmp_path, documents=[dict(doc_id=i, text=t) for i, t in enumerate(docs)], eval_item=[dict(item_id=i, text=t) for i, t in enumerate(items)])
    runs = lambda t: {tuple(w[k : k + 10]) for w in [words(t)] for k in range(len(w) - 9)}
    want = {(i, j) for i, a in enumerate(docs) for j, b in enumerate(items) if runs(a) & runs(b)}
    assert {tuple(x) for x in p09_leaks.found(spark, d).collect()} == want and len(want) > 20
    many = p09_leaks.Items([(1, "a b c d e f g h i j k l m n o p q r s t u v")])
    hit = many.search([p09_leaks.number("a b c d e f g h i j K x m n o p q r s t u v", many.vocab)])
    assert hit == [(0, 0, 11, 22)]


def test_gram_hashes():
    a = word_ids("a b c d e")
    assert len(gram_hashes(a, 3)) == 3 and len(gram_hashes(a, 6)) == 0 and gram_hashes(a, 2)[1] == gram_hashes(a[1:], 2)[0]


if __name__ == "__main__":
    pytest.main([__file__])
