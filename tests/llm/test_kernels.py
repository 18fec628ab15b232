"""Kernels without Spark, against plain Python."""

from __future__ import annotations

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrank.llm import bytetext as bt
from corpusrank.llm import decontaminate, gru, html_extract, isolation, jaccard, perfect_hash, pfair, wordids

TEXTS = st.lists(st.text(alphabet="ab AB\n\té|", max_size=12), max_size=8)


def bytes_of(texts):
    return bt.column_bytes(pa.array(texts, pa.string()))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_and_lines(texts):
    data, offsets = bytes_of(texts)
    starts, ends, rows = bt.spans(data, offsets, bt.WORD)
    got = [(r, data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall("[^\x20\x09-\x0d]+", t)]
    starts, ends, rows = bt.line_spans(data, offsets)
    assert [(r, data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)] == [(i, line) for i, t in enumerate(texts) for line in t.split("\n")]
    hashes = bt.span_hashes(data, starts, ends)
    lines = [line for t in texts for line in t.split("\n")]
    assert all((hashes[i] == hashes[j]) == (lines[i] == lines[j]) for i in range(len(lines)) for j in range(len(lines)))


def test_pieces_never_cut_texts():
    texts = ["x" * 10, None, "", "y" * 50, "z"]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"]).slice(1)
    got = [data[a:b].tobytes().decode() for _, data, o in bt.pieces(batch, "t", 8) for a, b in zip(o[:-1], o[1:])]
    assert got == ["", "", "y" * 50, "z"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcd ABé", max_size=30), max_size=6))
def test_shingles(texts):
    data, offsets = bytes_of(texts)
    _, n = jaccard.shingles(data, offsets, 3)
    want = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split(" ")
        w = [x for x in w if x]
        want.append(len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0)
    assert n.tolist() == want


def test_word_ids():
    import public_tokenizers

    encoder = wordids.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    signs = list("abcdesSTRVLM'' 's 12.,!\n\tÀéßñ&<|> _-")
    texts = ["don't 'sun ''s 're've'll it'LL", "", "<|endoftext|> hi", "日本 a ½ ª", "tab\x0bx\x1cy", "'", "x'", "s", "A" * 500, *("".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(800))]
    data, offsets = bytes_of(texts)
    ids, counts = encoder.encode(data, offsets)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in encoder.whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    keys = np.unique(keys)
    index = perfect_hash.IndexPart.build(keys, keys % 7, np.arange(len(keys)), np.ones(len(keys)), np.ones(len(keys)))
    assert sorted(index.perfect.slots(keys)) == list(range(len(keys)))
    index = perfect_hash.IndexPart.load(index.dump())
    entries, there = index.find(keys)
    assert there.all() and (entries["offset"] == np.arange(len(keys))).all()
    assert index.find(keys + 1)[1].mean() < 0.001
    nothing = np.zeros(0, np.int64)
    assert not perfect_hash.IndexPart.build(nothing, nothing, nothing, nothing, nothing).find(keys[:5])[1].any()


def test_automaton_offsets():
    words = [f"w{i}" for i in range(12)]
    automaton = decontaminate.build_automaton([(1, " ".join(words)), (2, "Short, ITEM"), (3, None), (4, "...")])
    text = "é (short... item)\n" + " ".join(words[:11]).upper() + " x"
    hits = decontaminate.TextHits(text.encode(), [automaton])
    assert hits.n_words == 15 and hits.items == {1, 2} and int(hits.hit().sum()) == 13
    assert [text[a:b] for a, b in hits.spans(text.encode())] == ["short... item)\n" + " ".join(words[:11]).upper()]
    assert decontaminate.build_automaton([]) is None


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 1, (600, 3)), rng.normal(9, 1, (12, 3))])
    score = isolation.IsolationForest.fit(points).score(points)
    assert np.sort(np.argsort(-score)[:12]).tolist() == list(range(600, 612))
    assert np.isfinite(isolation.IsolationForest.fit(np.zeros((5, 2))).score(np.zeros((2, 2)))).all()


@pytest.mark.parametrize("stat, value", [("n_digits", 900), ("n_distinct", 9), ("n_repeat_words", 110), ("n_dup_lines", 98), ("n_same", 11)])
def test_isolation_features_see_every_rule(stat, value):
    plain = dict.fromkeys(isolation.STATS, 0) | {"n_words": 400, "word_chars": 2000, "n_lines": 200, "n_distinct": 220}
    rates = [isolation.features({k: np.array([v]) for k, v in s.items()}) for s in (plain, plain | {stat: value})]
    assert np.abs(rates[1] - rates[0]).max() > 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.floats(0.05, 5)), min_size=1, max_size=7), st.sampled_from([1, 4]))
def test_pfair_plan(sources, block):
    docs, weights = [n for n, _ in sources], [w for _, w in sources]
    plan = pfair.Plan(docs, weights, block, period=64)
    placed = [plan.place(i, np.arange(n)) for i, n in enumerate(docs)]
    assert np.sort(np.concatenate([p["position"] for p in placed])).tolist() == list(range(sum(docs)))
    for p, stretches in zip(placed, plan.stretches):
        assert (p["release"] <= p["slot"]).all() and (p["slot"] < p["deadline"]).all()
    # Less than one block from the share, at every slot of the first phase.
    end = min((max(p["slot"]) for p in placed), default=0)
    for p, s in zip(placed, plan.stretches):
        slots = np.unique(p["slot"])
        for t in range(0, end + 1, max(1, end // 50)):
            assert abs(np.searchsorted(slots, t) - t * s[0].share / plan.period) < 1


def test_pfair_exact_over_many_periods():
    docs, weights = [100_000] * 20 + [70_000, 900], [1.0] * 20 + [0.3, 0.7]
    plan = pfair.Plan(docs, weights, 4)
    placed = [np.unique(plan.place(i, np.arange(n))["slot"]) for i, n in enumerate(docs)]
    assert np.sort(np.concatenate(placed)).tolist() == list(range(sum(docs) // 4))
    # In the fluid mix every source with blocks left gets its weight's part of each slot.
    times = sorted(range(len(docs)), key=lambda i: docs[i] / weights[i])
    for t in range(0, sum(docs) // 4, 997):
        left, active = float(t), list(times)
        v = 0.0
        while active and (docs[active[0]] / 4 / weights[active[0]] - v) * sum(weights[i] for i in active) < left:
            left -= (docs[active[0]] / 4 / weights[active[0]] - v) * sum(weights[i] for i in active)
            v = docs[active[0]] / 4 / weights[active.pop(0)]
        v += left / sum(weights[i] for i in active)
        fluid = [min(n / 4, v * w) for n, w in zip(docs, weights)]
        assert max(abs(np.searchsorted(s, t) - f) for s, f in zip(placed, fluid)) < 1.0001


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.floats(0.05, 5)), min_size=1, max_size=6))
def test_pfair_laid_by_stretches(sources):
    """Earliest deadline first, slot by slot, whatever number of blocks is laid at a time."""
    docs, weights = [n for n, _ in sources], [w for _, w in sources]
    plan = pfair.Plan(docs, weights, 3)
    owner = np.repeat(np.arange(len(docs)), plan.blocks)
    block = np.concatenate([np.arange(n) for n in plan.blocks])
    left = sorted(zip(*(x.tolist() for x in (plan.windows(owner, block)[1], owner, block, plan.windows(owner, block)[0]))))
    want, position = [], 0
    for slot in range(len(left)):
        deadline, source, number, release = best = next(b for b in left if b[3] <= slot)
        left.remove(best)
        want.append((source, number, release, deadline, slot, position))
        position += min(3, docs[source] - 3 * number)
    for stretch in (1, 10, 10**6):
        parts = list(plan.laid(stretch))
        assert [r for p in parts for r in zip(*(p[c].tolist() for c in ("source", "block", "release", "deadline", "slot", "position")))] == want


def test_pfair_windows_of_large_sources():
    """Exact where products take more than 64 bits."""
    plan = pfair.Plan([1 << 40, 1 << 34, 5], [1.0, 0.3, 0.7], 1)
    assert plan.kind is object
    ended, share = 5 + (1 << 34), int(plan.shares[0])
    block = np.array([(1 << 40) - 1, (1 << 39) + 12_345, 7])
    release, deadline = plan.windows(np.zeros(3, np.int64), block)
    assert release[:2].tolist() == [ended + int(b) for b in block[:2]] and deadline[:2].tolist() == [ended + int(b) + 1 for b in block[:2]]
    assert (release[2], deadline[2]) == (7 * plan.period // share, -(-8 * plan.period // share))


def test_pfair_limits():
    assert sum(pfair.apportion([1e-9, 5, 1], 64)) == 64 and min(pfair.apportion([1e-9, 5, 1], 64)) == 1


def test_gru_gradient():
    """Backpropagation against differences, over one window."""
    shape = gru.Shape(128, 5)
    flat = gru.initial(shape, np.ones(128))
    rng = np.random.default_rng(2)
    tokens, lengths = rng.integers(0, 128, 30), np.array([7, 1, 12, 10])
    lanes = gru.Lanes(lengths, 3)
    y = tokens[lanes.index]
    x = np.concatenate([[0], y[:-1]]) * ~lanes.first
    at, there = next(lanes.windows(20))
    keep = (~lanes.first[at]).astype(np.float32)
    h = np.zeros((at.shape[1], 5), np.float32)
    loss = lambda f: gru.Model(shape, f).gradient(x[at], y[at], there, keep, h)[2]
    grad = gru.Model(shape, flat).gradient(x[at], y[at], there, keep, h)[0]
    for i in np.argsort(-np.abs(grad))[:: len(grad) // 60][:40]:
        step = np.zeros_like(flat)
        step[i] = 1e-2
        assert (loss(flat + step) - loss(flat - step)) / 2e-2 == pytest.approx(grad[i], abs=3e-4, rel=0.05)


def test_gru_carries_state_and_is_proper():
    shape = gru.Shape(128, 6)
    model = gru.Model(shape, gru.initial(shape, np.arange(128)) * 2)
    tokens = np.random.default_rng(4).integers(0, 128, 60)
    whole = gru.score(model, tokens, np.array([40, 20]), lanes=2, steps=1000)
    assert np.allclose(whole, gru.score(model, tokens, np.array([40, 20]), lanes=1, steps=3), atol=1e-4)
    alone = gru.score(model, tokens[40:], np.array([20]))
    assert np.allclose(whole[40:], alone, atol=1e-4)
    hs = np.random.default_rng(5).normal(size=(1, 6)).astype(np.float32).repeat(128, axis=0)
    assert np.exp(model.log_probs(hs, np.arange(128))[0]).sum() == pytest.approx(1, abs=1e-4)
    assert len(gru.score(model, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_gru_sums_by_word():
    rng = np.random.default_rng(5)
    word = rng.zipf(1.4, 3000) % 200
    rows = rng.normal(size=(3000, 6)).astype(np.float32)
    seen, sums = gru.sums_by_word(rows, word, 256)
    assert sorted(seen.tolist()) == np.unique(word).tolist()
    assert all(np.allclose(s, rows[word == w].sum(axis=0), atol=1e-3) for w, s in zip(seen, sums))
    assert (np.bincount(word) > gru.FREQUENT).any() and (np.bincount(word) == 1).any()


def test_gru_scoring_holds_one_step():
    """Without gradients a step's gates are dropped with the step, so the states are what a window costs."""
    shape = gru.Shape(128, 8)
    model = gru.Model(shape, gru.initial(shape, np.ones(128)))
    x, keep = np.zeros((500, 64), np.int64), np.ones((500, 64), np.float32)
    tracemalloc.start()
    out, _, _ = model.recur(x, keep, np.zeros((64, 8), np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * out.nbytes


def test_gru_learns():
    shape = gru.Shape(128, 8)
    pattern = np.tile(np.arange(64, 72), 400)
    trainer = gru.Trainer(gru.Model(shape, gru.initial(shape, np.bincount(pattern, minlength=128))), rate=0.03, lanes=4, steps=16)
    lengths = np.full(40, 80)
    before = gru.score(trainer.model, pattern, lengths).mean()
    for _ in range(4):
        trainer.learn(pattern, lengths)
    assert gru.score(trainer.model, pattern, lengths).mean() > before + 1


PAGE = """<html><head><title>T</title></head><body><header><a href=/>Site name</a></header><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site</div>
<main><h1>The &quot;title&quot;</h1><p>First   paragraph with <b>bold</b>text &amp; more words here.<p>Second&nbsp;one<br>after a break, quite long enough.</p><div class="ad-box"><p>Buy now</p></div><aside>Related</aside>
<p>Third paragraph ends the article now.</p><script>var x = "<p>no</p>";</script><form><p>Subscribe here</p></form></main><section id="comments"><p>A reader comment which is long but not content.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html():
    weights = html_extract.learn(html_extract.count_features([PAGE] * 20))
    text = 'The "title"\nFirst paragraph with boldtext & more words here.\nSecond one\nafter a break, quite long enough.\nThird paragraph ends the article now.'
    assert html_extract.extract(PAGE, weights) == text
    assert html_extract.extract(PAGE.replace("main>", "div>"), weights) == text
    for empty in (None, "", "<", "<!-- x", "<nav>a b c</nav>", "<script>x"):
        assert html_extract.extract(empty, weights) in ("", "<")


@pytest.mark.parametrize("before", [
    "<head><meta charset=utf-8><title>T</title><body>", "<head><title>T</title><script>1</script>", "<svg-icon name=a></svg-icon>", "<select-box>", "<object-viewer></object-viewer>",
    "<svg viewBox='0'/>", "<svg>", "<select>", "<button>", "<head><title>T</title></head><select><option>x</option></select>", "<svg><path/></svg>",
])
def test_html_raw_elements(before):
    text = "First paragraph with words enough.\nSecond paragraph with words enough."
    assert html_extract.extract(before + "<p>First paragraph with words enough.</p><p>Second paragraph with words enough.</p>", {}) == text


@pytest.mark.parametrize("around", [
    '<div class="content with-sidebar"><article>{}</article><div class="sidebar"><p>Links here</p></div></div>', '<main class="has-sidebar">{}<p class="share">Share it</p></main>', '<main><article class="post comment-enabled">{}</article></main>',
    '<div class="content with-sidebar">{}<div class="sidebar"><p>Links here</p></div></div>', '<p>Top.</p><div id="legal-form">{}</div>',
])
def test_html_names_of_wrappers(around):
    body = "".join(f"<p>Paragraph {i} with quite enough words in it.</p>" for i in range(5))
    got = html_extract.extract(f"<body><nav><a>Home</a></nav>{around.format(body)}<footer>end</footer></body>", html_extract.learn(html_extract.count_features([PAGE] * 20)))
    assert [x for x in got.split("\n") if x != "Top."] == [f"Paragraph {i} with quite enough words in it." for i in range(5)]


def test_html_learns_names():
    """A class name that wraps content on labelled pages isn't side matter on others, however short the element."""
    page = '<body><div class="social">{}</div><p>Long long long long long long long long long text.</p></body>'
    weights = html_extract.learn(html_extract.count_features([page.format("<article>" + "<p>word word word word word</p>" * 5 + "</article>")] * 20))
    assert weights[".social"] > 0 and "Short one" in html_extract.extract(page.format("<p>Short one of only eight words in here.</p>"), weights)


def brute_run(scores):
    best, at = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            if (s := sum(scores[i : j + 1])) > best + 1e-9:
                best, at = s, (i, j + 1)
    return best, at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_best_run(scores):
    a, b = html_extract.best_run(np.array(scores, float))
    assert sum(scores[a:b]) == brute_run(scores)[0]


def test_crc_of_ids_as_32_bits():
    assert zlib.crc32(np.array([1, 2], "<u2").astype("<u4")) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
