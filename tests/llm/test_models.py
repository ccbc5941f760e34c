import json
import math
import random
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import hpylm, html, langid, toxicity


def best_segments(s):
    """All maximal segments by definition: repeatedly the best segment, then left and right of it."""
    total, best = 0.0, (0, 0, 0.0)
    for i in range(len(s)):
        total = 0.0
        for j in range(i, len(s)):
            total += s[j]
            if total > best[2] + 1e-12:
                best = (i, j + 1, total)
    if best[2] <= 0:
        return []
    a, b, _ = best
    return best_segments(s[:a]) + [best] + [(x + b, y + b, z) for x, y, z in best_segments(s[b:])]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments(seed):
    s = np.array([random.Random(seed * 100 + k).uniform(-2.5, 2.0) for k in range(25)])  # no ties
    got = sorted((a, b, round(z, 9)) for a, b, z in toxicity.maximal_segments(s))
    assert got == sorted((a, b, round(z, 9)) for a, b, z in best_segments(s))


def test_toxicity_learns_words_and_beginnings(spark):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "tu", "ne", "so") for c in ("n", "s", "t", "d", "k")]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        y = i % 5 == 0
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["scumlord", f"vilethi{r.choice(words)}"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(y)))
    docs += [(900, None, "x"), (901, "", "x"), (902, "x " * 20000, "x")]
    labels += [(0, 1, None), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in toxicity.score_documents(d, m).collect()}
    wrong = sum(got[i].predicted != (i % 5 == 0) for i in range(600))
    assert wrong <= 6 and got[900].score == got[901].score < 0.5
    assert toxicity.score_documents(d.limit(0), m).count() == 0
    assert {x.score < 0.5 for x in toxicity.score_documents(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {True}


def calibration(seed, n=3000, toxic=280):
    """Features of clean and toxic texts as `fit` meets them: nearly apart, a few labels wrong, a few texts far out."""
    r = np.random.default_rng(seed)
    y = (np.arange(n) < toxic).astype(float)
    top = np.where(y > 0, np.exp(r.normal(4, 0.5, n)), r.normal(-0.4, 2, n))
    top[:2] = 900.0, 1000.0
    top[-12:] = np.exp(r.normal(3.5, 0.7, 12))
    return np.column_stack([top, np.log1p(np.maximum(top, 0) * r.uniform(1, 1.2, n))]), y


@pytest.mark.parametrize("seed", range(8))
def test_toxicity_curve_settles_where_full_steps_cycle(seed):
    x, y = calibration(seed)
    curve = np.array(toxicity._fit_curve(x, y))
    flagged = curve[0] + x @ curve[1:] > 0
    assert flagged[y > 0].mean() > 0.95 and flagged[y == 0].mean() < 0.01
    loss = lambda w: np.logaddexp(0, (z := w[0] + x @ w[1:])).sum() - y @ z + 5e-3 * (w @ w)
    for k in range(3):
        for d in (-1e-3, 1e-3):
            near = curve + d * (np.arange(3) == k)
            assert (near[1:] < 0).any() or loss(near) >= loss(curve) - 1e-6


@pytest.mark.parametrize("seed", range(8))
def test_more_toxic_words_never_lower_a_score(seed):
    m = toxicity.ToxicModel({"scumlord" + toxicity.FULL: 3.0}, curve=toxicity._fit_curve(*calibration(seed)))
    assert min(m.curve[1:]) >= 0
    scores = [s[0] for s in toxicity.text_scorer(m)(["scumlord " * n for n in (0, 1, 10, 100, 1000, 20000)])]
    assert scores == sorted(scores) and scores[0] < 0.5 < scores[-1]


def test_recurrent_gradients():
    net = langid.ByteGRU.fresh(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = langid.columns_of([b"hello", b"world", b"gruss"]), np.array([0, 1, 2])
    _, g = net.gradients(x, y)
    r = np.random.default_rng(0)
    for name in net.p:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in net.p[name].shape)
            if name.startswith("x"):
                at = (int(x[2, 0]), at[1])
            keep, eps = net.p[name][at], 1e-3
            net.p[name][at] = keep + eps
            up = net.gradients(x, y)[0]
            net.p[name][at] = keep - eps
            down = net.gradients(x, y)[0]
            net.p[name][at] = keep
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at])


def test_language_identification(spark):
    r = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "lich", "ü"], "fr": ["eau", "ère", "oi", "que"]}
    rows = [(i, " ".join("".join(r.choices(parts[g], k=r.randint(1, 3))) for _ in range(12)), g) for i, g in enumerate(r.choice(list(parts)) for _ in range(600))]
    rows += [(700, None, "en"), (701, "", None), (702, "123 -- 45", "en"), (703, "theing" * 9000, "en")]
    d = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, score string")
    net = langid.fit(d, docs_per_lang=150)
    got = {x.doc_id: x for x in langid.label_documents(d, net).collect()}
    held = [(i, g) for i, _, g in rows[:600] if crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == g for i, g in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (700, 701, 702)] == ["und"] * 3 and got[703].lang_pred == "en"
    assert langid.label_documents(d.limit(0), langid.fit(d.limit(0))).count() == 0


def test_pitman_yor_counts_and_perplexity(spark):
    r = random.Random(9)
    chain = {w: r.sample([f"w{i}" for i in range(50)], 3) for w in [f"w{i}" for i in range(50)]}
    rows = []
    for i in range(300):
        w = ["w0"]
        for _ in range(r.randint(5, 60)):
            w.append(r.choice(chain[w[-1]]))
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(900, None), (901, "new words only"), (902, "w1 " * 3000), (3, rows[3][1])]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int").repartition(5)
    got = hpylm.score_documents(d).collect()
    assert len(got) == len(rows)
    from collections import Counter

    c = Counter(t for i, x in rows if crc32(str(i).encode()) % 7 != 2 for t in hpylm.tokens_of(x or ""))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for x in got:
        t = hpylm.tokens_of(texts[x.doc_id] or "")
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(x.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)  # the chain's structure is learned
    assert hpylm.score_documents(d.limit(0)).count() == 0
    assert hpylm.perplexity(hpylm.score_documents(d)).count() == 2


def test_table_numbers_follow_the_chinese_restaurant():
    d, theta_p = 0.5, 0.7
    lone = hpylm.lone_table(d)
    rng = np.random.default_rng(1)
    c = np.full(4000, 6)
    t = hpylm.reseat(rng, c, np.ones(4000, dtype=np.int64), lone, d, np.full(4000, theta_p), 80)
    # exact: weight of t tables is S(6, t) * theta_p ** t up to a constant
    s = np.zeros((7, 7))
    s[0, 0] = 1
    for n in range(1, 7):
        for k in range(1, n + 1):
            s[n, k] = s[n - 1, k - 1] + max(0.0, n - 1 - d * k) * s[n - 1, k]
    w = np.array([s[6, k] * theta_p**k for k in range(7)])
    assert abs(np.bincount(t, minlength=7)[:7] / 4000 - w / w.sum()).max() < 0.03


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav class="menu"><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Ti&amp;tle</h1><p>First <b>bo</b>ld<br>line &eacute;<p>Second&nbsp;one<!-- no --></article>
<aside>side</aside><section id="comments"><p>nice post</p></section><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Ti&tle First bold line é Second one"
    assert html.main_text("") == "" and html.main_text("<p>a<p>b") == "a b" and html.main_text("plain < text") == "plain < text"
    plain = PAGE.replace("<article>", "<div id=content>").replace("</article>", "</div>")
    assert html.main_text(plain) == "Ti&tle First bold line é Second one"


def test_wrapper_has_slots_optionals_and_repeats():
    a = "<html><body><div class=top>Same</div><ul><li>a<li>b</ul><div class=c>one</div></body></html>"
    b = "<html><body><div class=top>Same</div><p>extra</p><ul><li>c</ul><div class=c>two</div></body></html>"
    w = html.infer([a, b])
    text = str(w)
    assert "'plus', ['tag', 'li'" in text and "'opt', [['tag', 'p'" in text and "['text', None, 3]" in text and "['text', None, 6]" in text and "['text', 'Same', 8]" in text
    assert any(p.endswith("div.top") for p in html.constant_paths(w))


def test_pages(spark):
    rows = [(i, "http://h.example/x" if i % 2 else None, PAGE.replace("Second", f"Text {i}")) for i in range(12)] + [(50, "::", None), (51, "http://h.example/", "")] + [(0, None, PAGE.replace("Second", "Text 0"))]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")
    got = html.extract(df, html.wrappers(df)).collect()
    assert len(got) == len(rows)
    assert {x.page_id: x.text for x in got}[5] == "Ti&tle First bold line é Text 5 one" and {x.page_id: x.n_chars for x in got}[50] == 0
    assert html.extract(df.limit(0), html.wrappers(df.limit(0))).count() == 0


def test_template_is_judged_by_all_items_of_a_path_and_by_whole_texts():
    page = lambda i, extra="": f"<html><body><div class=c><h1>Title</h1><p>a {i}</p><p>b {i}</p><ul><li>x</ul>{extra}</div></body></html>"
    w = html.infer([page(0), page(1, "<p>once</p>"), page(2), page(3, "<div>only here</div>")])
    paths = html.constant_paths(w)
    assert "/html/body/div.c/p" not in paths and "/html/body/div.c/div" not in paths and "/html/body/div.c/ul" in paths
    long = [f"<body><div class=x>{'same ' * 60}{i}</div></body>" for i in range(3)]
    assert not html.constant_paths(html.infer(long))
    assert not html.constant_paths(html.infer([PAGE] * 5))  # copies are one page
    w = html.infer(["<body>" + "<div><p>" * 400 + f"{i} deep" + "</div>" * 400 + "<i>t</i></body>" for i in range(3)])
    assert html.unpacked(html.packed(w)) == w


def test_deep_elements_close_only_themselves():
    deep = "<body><div><article><p>first</p>" + "<div>" * 3000 + "inner" + "</div>" * 3000 + "<p>after</p></article></div><footer>f</footer></body>"
    assert html.main_text(deep) == "first inner after"


def test_unclosed_tags_take_linear_time():
    began = time.process_time()
    assert html.main_text("<body><p>text</p>" + '<a "' * 250_000).startswith("text")
    assert html.main_text("<p>a</p><!-- " + "<b " * 100_000) == "a"
    assert time.process_time() - began < 20  # quadratic: an hour


def test_all_pages_of_a_host_teach_its_wrapper(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class=a>{'same' if i < 60 else f'late {i}'}</div><div class=c><p>text {i}</p></div></body>") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = html.wrappers(df, group=4).collect()
    assert {x.host: x.paths for x in found} == {f"h{k}.example": "[]" for k in (0, 1)}  # 20 late pages differ
    assert html.wrappers(df.repartition(2), group=4).collect() and {x.host: x.paths for x in html.wrappers(df.filter("page_id < 60"), group=4).collect()} != {x.host: x.paths for x in found}
    got = {x.page_id: x.text for x in html.extract(df, html.wrappers(df, group=4)).collect()}
    assert got[70] == "late 70 text 70"


def test_marked_pages_take_region_and_template_from_the_wrapper(spark):
    page = lambda i, n=20: f"<body><article class=about><p>We are a paper.</p></article><div class=c><h2>News</h2><p>story {i} " + "long text " * n + "</p><p class=more>Read more in our app</p></div></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(6)] + [(9, "http://one.example/", page(9, 0))], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract(df, html.wrappers(df)).collect()}
    assert got[3] == ("News story 3 " + "long text " * 20).strip()  # neither the marked template nor the one in the region
    assert got[9] == "We are a paper."  # a host with one page, no region with nearly all text: marks decide


def test_slots_choose_the_region_where_neither_words_nor_marks_tell(spark):
    side = "<div class=left><p>" + "an offer of the day " * 3 + "{i}</p></div>"
    page = lambda i, n: f"<body>{side.format(i=i)}<div class=story><p>story {i} " + "of the town " * n + "</p></div></body>"
    rows = [(i, "http://h.example/", page(i, 40)) for i in range(8)] + [(9, "http://h.example/", page(9, 1)), (10, "http://one.example/", page(10, 1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.wrappers(df, group=3)
    got = {x.page_id: x.text for x in html.extract(df, found).collect()}
    assert got[9] == "story 9 of the town"  # alone, the side would outweigh it
    assert got[10].endswith("story 10 of the town") and got[10].startswith("an offer")
    assert {x.host: len(json.loads(x.slots)) for x in found.collect()} == {"h.example": 3, "one.example": 0}


def test_lists_of_teasers_weigh_nothing():
    teaser = lambda i, k: f"<div class=item><a href=x>headline {i} {k} goes here</a><p>some words about it {i} {k}</p></div>"
    page = lambda i: "<body><div class=list>" + "".join(teaser(i, k) for k in range(9)) + f"</div><div class=story><p>story {i} is short</p></div></body>"
    pages = [page(i) for i in range(5)]
    w = html.infer(pages)
    assert html.main_text(pages[2], html.template_paths(w), html.slot_weights(w)) == "story 2 is short"
    assert html.main_text(pages[2]) != "story 2 is short"


def slow_align(a, b, same=False):
    """`html.align` by scanning ahead at every mismatch."""
    name, out, i, j = html._name, [], 0, 0
    while i < len(a) and j < len(b):
        if name(a[i]) == name(b[j]):
            out.append(html._merge(a[i], b[j], same))
            i, j = i + 1, j + 1
            continue
        p = next((k for k in range(i + 1, len(a)) if name(a[k]) == name(b[j])), None)
        q = next((k for k in range(j + 1, len(b)) if name(b[k]) == name(a[i])), None)
        n, m = (1, 1) if p is None and q is None else (p - i, 0) if q is None or p is not None and p - i <= q - j else (0, q - j)
        out += [html._optional(x) for x in a[i : i + n] + b[j : j + m]]
        i, j = i + n, j + m
    return out + [html._optional(x) for x in a[i:] + b[j:]]


def test_alignment_equals_the_slow_one_and_takes_linear_time(monkeypatch):
    rng = np.random.default_rng(3)
    pages = ["<body>" + "".join(f"<{t}>{rng.integers(3)}<{u}>x{rng.integers(2)}</{u}></{t}>" for t, u in zip(rng.choice(["div", "ul", "h2", "table"], 9), rng.choice(["b", "i", "em"], 9))) + "</body>" for _ in range(30)]
    fast = html.infer(pages)
    assert html.unpacked(html.packed(fast)) == fast
    monkeypatch.setattr(html, "align", slow_align)
    assert html.infer(pages) == fast
    monkeypatch.undo()
    letters = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    began = time.process_time()
    html.infer(["<body>" + "".join(f"<div class=x{letters(2 * k + i)}>t</div>" for k in range(50_000)) + "</body>" for i in range(2)])
    html.infer(["<body>" + "".join(f"<div><i class=x{letters(k)}>t</i></div>" for k in range(20_000)) + "</body>"])
    assert time.process_time() - began < 30  # quadratic: a quarter of an hour


def slow_probs(net, raw):
    """Probabilities of all positions by one pass over the whole text in either direction."""
    def step(x, d, h):
        k = len(h)
        a = net.p["x" + d][x] + net.p["c" + d]
        z, r = (1 / (1 + np.exp(-(a[i * k : (i + 1) * k] + h @ net.p["u" + d][:, i * k : (i + 1) * k]))) for i in (0, 1))
        return h + z * (np.tanh(a[2 * k :] + (r * h) @ net.p["u" + d][:, 2 * k :]) - h)

    sides = []
    for d, order in (("f", raw), ("b", raw[::-1])):
        h, out = np.zeros(net.p["u" + d].shape[0]), []
        for x in order:
            h = step(x, d, h)
            out.append(h)
        sides.append(np.array(out if d == "f" else out[::-1]))
    s = np.concatenate(sides, axis=1) @ net.p["o"] + net.p["q"]
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_windows_of_long_texts_label_as_one_pass_does(monkeypatch):
    monkeypatch.setattr(langid, "MARGIN", 100)  # so that what lies further back has faded
    monkeypatch.setattr(langid, "SLICE", 1000)
    net = langid.ByteGRU.fresh(["a", "b", "c"], hidden=4)
    r = random.Random(2)
    texts = ["".join(r.choice("abc dé1.") for _ in range(n)) for n in (0, 1, 127, 128, 129, 500, 3000)]
    got = langid.label_texts(net, texts)
    for t, (lang, score) in zip(texts, got):
        raw = langid.bytes_of(t)
        letters = [i for i, x in enumerate(raw) if x > 127 or chr(x).isalpha()]
        if not letters:
            assert (lang, score) == ("und", 0.0)
            continue
        around = b" " * 100
        p = slow_probs(net, around + raw + around)[100:-100][letters].mean(axis=0)
        assert abs(score - p.max()) < 0.02 and (net.langs[int(p.argmax())] == lang or np.sort(p)[-1] - np.sort(p)[-2] < 0.02)


def test_positions_have_labels_and_other_signs_are_no_letters(spark):
    r = random.Random(6)
    words = {"aa": ["alpha", "beta", "gamma"], "xx": ["xyzzy", "quux", "wq"]}
    rows = [(i, " ".join(r.choices(words[y], k=24)), y) for i, y in enumerate(["xx", "aa"] * 60)]
    mixed = "alpha beta gamma " * 20 + "xyzzy quux wq " * 20
    extra = [(500, "\u00b2\u00bd\u2460", None), (501, mixed, None), (502, None, None), (503, "\u4e2d", None), (504, "12 !?", "aa"), (1, rows[1][1], "aa")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows + extra], "doc_id long, text string, lang string, score double")
    net = langid.fit(df)
    got = {x.doc_id: x for x in langid.label_documents(df, net).collect()}
    assert [got[i].lang_pred for i in (500, 502, 504)] == ["und"] * 3 and got[500].score == 0 and got[503].lang_pred in ("aa", "xx")
    assert [(i, got[i]) for i, _, y in rows if got[i].lang_pred != y or got[i].score < 0.8] == []
    spans = {x.doc_id: x.spans for x in langid.label_spans(df, net).collect()}
    assert spans[502] == [] and sum(x.length for x in spans[501]) == len(mixed)
    n = np.zeros(2)
    for x in spans[501]:
        half = len("alpha beta gamma ") * 20
        first = max(0, min(x.start + x.length, half) - x.start)
        n += (first, x.length - first) if x.lang == "aa" else (0, 0)
    assert n[0] > 0.9 * half and n[1] < 0.1 * (len(mixed) - half)


def test_table_numbers_of_large_counts_converge():
    d, rng = 0.8, np.random.default_rng(3)
    lone = hpylm.lone_table(d)
    for c, mass in ((1000, 20.0), (3000, 5.0)):
        s = np.full(400, -np.inf)  # log S(n, t), t below 400
        s[0] = 0.0
        k = np.arange(400)
        for n in range(1, c + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = s + np.where(n - 1 - d * k > 0, np.log(np.maximum(n - 1 - d * k, 1e-300)), -np.inf)
            s = np.logaddexp(stay, np.concatenate([[-np.inf], s[:-1]]))
        w = np.exp(s + k * math.log(mass) - (s + k * math.log(mass)).max())
        exact = (w * k).sum() / w.sum()
        count, masses = np.full(2000, c), np.full(2000, mass)
        assert abs(hpylm.expected_tables(count, d, masses)[0] - exact) < 0.1 * exact
        t = np.ones(2000, dtype=np.int64)
        for _ in range(12):
            t = hpylm.reseat(rng, count, t, lone, d, masses)
        assert abs(t.mean() - exact) < 0.1 * exact


def test_contexts_of_equal_low_bits_stay_apart_and_blocks_do_not_matter(spark):
    met = {}
    for i in range(5000):
        a, b = met.setdefault(int(hpylm.token_hashes(pa.array([f"c{i}"]))[0][0]) & 0xFFFF, i), i
        if a != b:
            break
    assert a != b
    r = random.Random(4)
    rows = [(i, f"c{a} left" if i % 2 else f"c{b} right") for i in range(600)]
    rows += [(1000 + i, " ".join(r.choices([f"w{k}" for k in range(40)], k=30))) for i in range(200)]
    held = [i for i in range(5000, 5100) if crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], f"c{a} left"), (held[1], f"c{a} right")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({x.doc_id: x for x in hpylm.score_documents(df, least_blocks=n).collect()} for n in (4, 32))
    assert few[held[0]].score > few[held[1]].score + 1.0 and many[held[0]].score > many[held[1]].score + 1.0
    total = sum(x.score for x in few.values())
    assert abs(total - sum(x.score for x in many.values())) < 0.004 * abs(total)
