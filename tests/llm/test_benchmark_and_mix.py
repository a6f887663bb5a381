"""Decontamination, mixing, html."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, mixing
from tidemark.llm.tables import FILTER_BITS, membership, passes


def brute(texts, items, window=13):
    def words(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())

    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            b = words(x)
            n = min(window, len(b))
            if not n or item is None:
                continue
            for at in range(len(b) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[at : at + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_decontamination_matches_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(4)
    pool = [f"k{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, items[3][1]), (101, None), (102, ""), (None, "k1 k2"), (103, "a " * 40)]
    texts = []
    for i in range(60):
        t = [rnd.choice(pool) for _ in range(rnd.choice([0, 5, 40]))]
        for _ in range(rnd.choice([0, 1, 2])):
            b = (items[rnd.randrange(25)][1]).split()
            cut = rnd.choice([0, 0, 1])
            at = rnd.randrange(len(t) + 1)
            t[at:at] = b[cut:]
        texts.append((i, rnd.choice([" ", ", ", "\n"]).join(t).upper() if i % 2 else " ".join(t)))
    texts += [(60, None), (61, "A a-a a a. " * 30), (5, texts[5][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("n", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x")).withColumn("k", F.lit(3))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find_contamination(docs, bench).collect()]
    assert sorted(got) == sorted(brute(texts, items))
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    clean = decontaminate.find_contamination(odd_docs, bench.limit(0)).collect()
    assert len(clean) == odd_docs.count() and {r["n_hit"] for r in clean} == {0}


def test_filter_never_loses_a_key(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63, 3000)
    bitmap = membership(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert bitmap.nbytes == 2 ** (FILTER_BITS - 3)
    assert len(passes(bitmap, keys.view(np.uint64))) == len(keys)
    strangers = np.random.default_rng(3).integers(-(2**63), 2**63, 3000).view(np.uint64)
    assert len(passes(bitmap, strangers)) < 30


def test_targets_share_the_excess():
    words = np.array([100.0, 1000.0, 10.0, 0.0])
    weights = np.array([5.0, 2.0, 1.0, 5.0])
    goal = mixing.targets(words, weights, 1.5 * words.sum())
    assert goal.sum() == pytest.approx(1665) and (goal <= 2 * words + 1e-9).all()
    assert goal[0] == 200 and goal[2] == 20 and goal[3] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_draws_meet_what_is_owed():
    owed = np.array([1000, 3, 0, 250])
    drawn = mixing.draws(owed, 100, 1)
    assert (drawn.sum(0) == owed).all() and (drawn.sum(1)[:-1] == 100).all() and (drawn >= 0).all()
    assert (mixing.draws(owed, 100, 1) == drawn).all() and len(mixing.draws(owed * 0, 100, 1)) == 0


def test_mix_of_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "STREAM_WORDS", 5000)
    out = mixing.taken_words(odd_docs, block_words=16).collect()
    assert len(out) == odd_docs.count()
    rows = odd_docs.select("doc_id", "text", "source").collect()
    assert sorted(r["size"] for r in out) == sorted(len((r["text"] or "").split()) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    goal, taken = {}, {}
    for r in out:
        goal[r["source_size"]] = r["target"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    total = sum(r["size"] for r in out)
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - goal[s]) <= 48 for s in goal)
    again = mixing.taken_words(odd_docs, block_words=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.taken_words(no_docs).count() == 0


def test_pieces_of_a_block_make_up_its_words(odd_docs):
    docs, mixed = mixing.mix_sources(odd_docs, block_words=16)
    full = mixed.groupBy("shard", "slot", "sid").agg(F.sum("n_words").alias("n")).collect()
    assert max(r["n"] for r in full) == 16
    sizes = {r["row"]: r["size"] for r in docs.collect()}
    assert all(0 <= r["first_word"] and r["first_word"] + r["n_words"] <= sizes[r["row"]] for r in mixed.collect())


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<{nav}><ul><li><a href="/a">Start</a><li><a href="/b">News</a></ul></{nav_end}><!-- note --><{main}><h1>Head {i}</h1><p>First <b>para</b>graph{i} &amp; more&nbsp;words,
that go on for a while so that it is long.<br>Second line.<p>{text}</{main_end}><{foot}>&copy; site {i}</{foot_end}></body></html>"""


def page(i, nav="nav", main="article", foot="footer"):
    rnd = random.Random(i)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "and", "of"]) for _ in range(rnd.randrange(5, 60))) + "."
    end = {f"{k}_end": v.split()[0] for k, v in (("nav", nav), ("main", main), ("foot", foot))}
    want = f"Head {i} First paragraph{i} & more words, that go on for a while so that it is long. Second line. {text}"
    return PAGE.format(nav=nav, main=main, foot=foot, i=i, text=text, **end), want


def test_blocks_of_broken_markup():
    got = html_text.blocks("<div>a<p>b<p>c<i>d</i>e</div>f<table><tr><td>g<td>h</table><script>x</scr</script>&lt;i&gt;<!-- no")
    assert [b.text for b in got] == ["a", "b", "cde", "f", "g", "h", "<i>"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> \n </p><img src=x>") == []
    assert [b.text for b in html_text.blocks("<p>1 < 2 and 3 > 2")] == ["1 < 2 and 3 > 2"]
    both = html_text.blocks("<p hidden>x</p><p>y</p>")  # the labeller decides about hidden blocks
    assert [b.text for b in both] == ["x", "y"] and "hidden" in both[0].path[0] and "hidden" not in both[1].path[0]
    assert len(html_text.blocks("<div>" * 3000 + "deep")) == 1


def test_labeller_on_held_out_and_other_structures(spark):
    rows = [(i, f"u{i}", page(i)[0]) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    learned = html_text.train(pages)
    other = [(0, "u", page(900)[0]), (1, "u", page(901, 'div class="menu"', 'div class="content"', 'div id="footer"')[0]), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<nav>only</nav>")]
    got = html_text.extract(spark.createDataFrame(other, "page_id long, url string, html string"), learned).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and text[0] == page(900)[1] and text[1] == page(901)[1] and text[2] == text[3] == text[4] == ""
    assert html_text.extract(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


def test_lstm_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in html_text.new_parameters(rng).items()}
    coded = [html_text.encode(html_text.blocks(page(i)[0])) for i in range(3)]
    n = sum(len(c.numbers) for c in coded)
    y = rng.integers(0, 2, n)

    def loss():
        z, _ = html_text.forward(p, coded)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    z, memo = html_text.forward(p, coded, True)
    grads = html_text.backward(p, memo, (1 / (1 + np.exp(-z)) - y) / n)
    for name in p:
        at = tuple(int(i) for i in np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape))
        old, e = p[name][at], 1e-3
        p[name][at] = old + e
        up = loss()
        p[name][at] = old - e
        down = loss()
        p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=1e-4), name


def test_all_words_of_a_block_are_read():
    plain = " ".join(f"w{i}" for i in range(500))
    one, other = (html_text.encode(html_text.blocks(f"<div><p>{plain} {last}</p></div>")) for last in ("Telling", "Common"))
    assert len(one.words) == len(other.words) == 501 and (one.words[:500] == other.words[:500]).all() and one.words[500] != other.words[500]
    two = html_text.encode(html_text.blocks("<p>a b c</p><p>...</p><p>d</p>"))
    assert two.words_of.tolist() == [0, 0, 0, 2]


def test_late_words_decide_a_label(spark):
    """Bare pages whose paragraphs differ only in words after the first hundred."""
    words = [f"w{i}" for i in range(40)]

    def paragraph(i, late):
        return "<p>" + " ".join(words[(i * 7 + j * 3) % 40] for j in range(100)) + " " + " ".join([late] * 60) + ".</p>"

    learned = html_text.fit([html_text.blocks("<body>" + "".join(f"<{'article' if k else 'aside'}>{paragraph(i + j, 'gist' if k else 'advert')}</{'article' if k else 'aside'}>" for j, k in enumerate((i % 2, 1, 0, (i // 2) % 2, 1)))) for i in range(400)])
    bare = [html_text.blocks("<body>" + paragraph(i, "gist") + paragraph(i + 1, "advert") + paragraph(i + 2, "gist")) for i in range(20)]
    got = html_text.main_text(learned, bare)
    assert sum("advert" not in text and text.count("gist") == 120 for text in got) >= 18


def test_formulas_and_fallback_text_stay_in_their_line():
    def texts(page):
        return [b.text for b in html_text.blocks(page)]

    assert texts("<article><p>See <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p><p>b</p></article>") == ["See x=2 here", "b"]
    assert texts("<p>a <svg><path d='M0 0'/><text>label</text></svg> b</p>") == ["a label b"]
    assert texts("<p>a <object><em>plan</em></object><canvas>c</canvas><noscript>d</noscript> e</p><p>f</p>") == ["a plancd e", "f"]
    assert texts("<p>a<svg><g>open</p><div>b</div>") == ["aopen", "b"]
    assert texts("<p>a<script>x</script><template>y</template></p><form><button>z</button></form>") == ["a"]


def test_mix_does_not_depend_on_layout_and_takes_parts_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STREAM_WORDS", 300)
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i * 7 % 40)), "big" if i % 10 else "small") for i in range(120)] + [(500, "a b c " * 30, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, *others = (sorted(tuple(r) for r in mixing.taken_words(docs.repartition(n), block_words=16).collect()) for n in (1, 3, 7))
    assert all(x == first for x in others)
    by = {}
    for doc_id, size, source_size, target, taken in first:
        assert taken <= 2 * size
        by[target] = by.get(target, 0) + taken
    # streams of 300 words end in part blocks, so a slot holds 16 words or fewer: near the target, not on it
    assert len(by) == 3 and all(abs(taken - target) <= 16 + 0.03 * target for target, taken in by.items())
    # a source that owes less than a block gives just that
    small = spark.createDataFrame([(1, "a " * 1000, "x"), (2, "b " * 100, "y")], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r for r in mixing.taken_words(small, weights=(50.0, 1.0), share=0.9).collect()}
    assert 0 < taken[2]["target"] < 64 and abs(taken[2]["taken"] - taken[2]["target"]) <= 1
