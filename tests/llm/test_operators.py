"""Corpus operators against brute force, round trips and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from huegrid.llm import chat, common, decontamination, html_text, media, near_join, packing, pitman_yor, secrets, spans, toxicity

SCHEMA = "doc_id long, text string, start string, score double"  # start and score clash with names the operators use


def docs(spark, *texts, first=1):
    return spark.createDataFrame([(first + i, t, "x", 1.0) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", "   ", "\n\t", "a", "é" * 9, "word " * 30_000, "x" * 50_000, "same text here again", "same text here again", "<|endoftext|> <b>&amp; \\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(None, "no id at all in this row", "x", 1.0), (8, "same text here again", "x", 1.0)]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 packing ---------------------------------------------------------------


def check_pieces(rows, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == pieces[0].tier)
    return by_sequence


def test_packing_keeps_every_id_once(spark, odd, sf):
    texts = {i: t for i, t in enumerate(ODD) if i != 8}
    check_pieces(packing.packed(odd.where("doc_id <> 8")).collect(), texts)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    sequences = check_pieces(packing.packed(table).collect(), {r.doc_id: r.text for r in table.collect()})
    lengths = [sum(r.length for r in p) for p in sequences.values()]
    assert sum(1024 - n for n in lengths if n & (n - 1)) == 0  # nothing to pad


def test_packing_of_no_rows(empty, odd):
    assert packing.packed(empty).count() == 0
    assert packing.packed(odd).where("doc_id IS NULL").agg(F.sum("length")).first()[0] > 1


def test_encoder_equals_the_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encoder = packing.encoder_of(None)
    for text in [*filter(None, ODD), "a  b\n c \n\n d\t x  y it's   ", " lead", "trail ", "x　y z w", "don't 12 345!!\n\nNew  line", "  q  "]:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:40]


def test_added_tokens_inside_texts_are_those_of_the_library(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import corpus_pipeline

    tokenizer, token = Tokenizer.from_file(path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [f"a {token} b", token, token * 3, f"  {token}  \n{token}x y", f"<|endoftext {token[:-1]} |>", f"don{token}'t é{token}é", "none here", "", *filter(None, ODD)]
    table = docs(spark, *texts, first=0)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for rows in (packing.op1_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, table, "")):
        pieces = collections.defaultdict(list)
        for r in rows.collect():
            pieces[r.doc_id].append(r)
        for doc, text in enumerate(texts):
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
            for r in pieces[doc]:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()), text[:40]
            assert sum(r.length for r in pieces[doc]) == len(ids)


def test_step_groups_weigh_the_same(spark, sf):
    rows = packing.packed(spark.read.parquet(f"{sf}/documents.parquet").repartition(1), step_tokens=4096)
    weights = sorted(r[1] for r in rows.groupBy("step_group").agg(F.sum("length")).collect())
    assert weights[-1] == 4096 and sum(w < 4096 for w in weights) <= 2


# ---- 2 html ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A  title &amp; more</h1><p>First&nbsp;paragraph of the text with <b>bold</b> words in it.<br>Second line.</p>
<script>var x = "</p>";</script><p>Another paragraph that has some more words, and a comma.</p></article><footer>&copy; all rights</footer></body></html>"""


def test_blocks_and_references():
    texts = [b.text for b in html_text.blocks_of(PAGE)]
    assert texts == ["Menu", "More", "Buy this now.", "A title & more", "First paragraph of the text with bold words in it. Second line.", "Another paragraph that has some more words, and a comma.", "© all rights"]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("") == []
    assert [b.text for b in html_text.blocks_of("a < b <p>c<p>d <!-- e")] == ["a < b", "c", "d"]


def test_blocks_of_pages_without_end_tags():
    def texts(page):
        return [b.text for b in html_text.blocks_of(page)]

    assert texts("<!doctype html><html><head><meta charset=utf-8><title>T</title><style>a{}</style><body><p>One.</p><p>Two.") == ["One.", "Two."]
    assert texts("<html><head><title>T</title><script>'<p>'</script><link rel=x><!-- c --><article><p>One.</article>") == ["One."]
    assert texts("<head><title>T</title>Bare text<p>Two.") == ["Bare text", "Two."]
    assert texts("<head><title>T</title></head><header>H</header><p>One.") == ["H", "One."]
    for empty in ("<svg width='1' />", "<math/>", '<iframe src="/x"/>', "<object/>", "<canvas />", "<noscript/>", "<svg><path d='M0'/></svg>", "<svg><title>t</title><desc><p>d</p></desc></svg>", "<svg><svg>a</svg>b</svg>"):
        assert texts(f"<article><p>One.</p>{empty}<p>Two.</p></article><svg><text>no</text></svg><iframe>no</iframe><p>Three.") == ["One.", "Two.", "Three."], empty
    for left_open in ("<svg>", "<object>", "<canvas>", "<template>", "<noscript>"):
        assert texts(f"<article><p>One.</p>{left_open}<p>Two.</p></article><p>Three.") == ["One.", "Two.", "Three."], left_open
    assert texts("<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x^2</annotation></math> holds.</p>") == ["Here x=2 holds."]
    assert texts("<p>One.</p><script>var a = '<p>no</p>';") == ["One."] == texts("<p>One.</p><style>p{} <p>no") == texts("<p>One.<iframe src=/a/><p>no")


def test_elements_inside_a_sentence_do_not_split_it():
    for inner in ("<script>var a;</script>", "<svg><path d='M0'/></svg>", "<noscript><img src=x></noscript>", "<template><p>no</p></template>", "<b> </b>"):
        assert [b.text for b in html_text.blocks_of(f"<article><p>Hello {inner}world again.</p></article>")] == ["Hello world again."], inner


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    for page in ("<div>" * 100_000 + "<span>deep</span>" * 10, "<div><b>" * 50_000 + "x", "<p><article>" + "<span>" * 50_000 + "</p>" * 50_000 + "y"):
        assert len(html_text.blocks_of(page)) == 1
    assert time.process_time() - began < 10


def test_pages_without_marks_teach_nothing():
    assert all(np.array_equal(html_text.train(["<div class=content><p>Some text.</p></div>"]).p[k], html_text.Labeller().p[k]) for k in html_text.Labeller().p)


def test_labeller_on_pages_it_has_not_seen(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet").orderBy("page_id").collect()]
    labeller = html_text.train([h for _, h in pages[:120]])
    held = [h for _, h in pages[120:]]
    got = html_text.main_texts(held, labeller)
    want = ["\n\n".join(b.text for b in html_text.blocks_of(h) if html_text.markup_label(b)) for h in held]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(held)
    random, other = np.random.default_rng(5), [b.text for h in held for b in html_text.blocks_of(h)]
    right = total = 0
    for h in held:
        made, labels = html_text.variant(html_text.blocks_of(h), other, random)
        (found,) = labeller.labels([html_text.features(made)])
        right, total = right + (found == np.array(labels, bool)).sum(), total + len(labels)
    assert right >= 0.97 * total


def test_gradients_of_the_network():
    random = np.random.default_rng(0)
    net = html_text.Labeller()
    x, there = html_text.padded([random.normal(size=(n, html_text.INPUT)).astype(np.float32) for n in (4, 2)])
    y = (random.random(there.shape) < 0.5).astype(np.float32)

    def loss():
        z = net.logits(x, there).astype(np.float64)
        return float((np.where(there, np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y, 0)).sum() / there.sum())

    grads = net._gradients(x, y, there)
    for name in ("wf", "wb", "cf", "o", "d"):
        flat = net.p[name].reshape(-1)
        for k in random.integers(0, len(flat), 3):
            old, eps = flat[k], 1e-2
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_html_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p"), (4, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = html_text.extract(rows, html_text.train([PAGE] * 3))
    assert got.count() == 6 and got.where("n_chars <> length(text) OR text IS NULL").count() == 0
    assert html_text.extract(rows.limit(0)).count() == 0


# ---- 3 language model --------------------------------------------------------


def test_base_score_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pitman_yor.score(table, stable=True).collect()
    texts = {r.doc_id: common.words_of(r.text) + [b"\n"] for r in table.collect()}
    count = collections.Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chances_sum_to_one():
    """After every context, all known words (the end is one) and the unknown one share the whole mass, averaged over the sweeps."""
    import pandas as pd

    words = [f"w{i}" for i in range(12)]
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(words, 40)) for _ in range(30)]
    after = ["", *words, "never"]
    ask = [*texts, *(f"{a} {b}".strip() for a in after for b in after)]
    model, slots = pitman_yor.Model(), 3
    requests = pd.concat([b.to_pandas() for b in pitman_yor._request(0, ask, [True] * 30 + [False] * (len(ask) - 30), slots)])
    answers = pd.concat([model.answer(g, slots) for _, g in requests.groupby("slot")])
    ends = answers[answers.part < 0].groupby("part").totals.apply(lambda t: np.sum(list(t), axis=0))
    totals = np.concatenate([ends[k] for k in sorted(ends.index, reverse=True)])
    answers = answers[answers.part >= 0].sort_values("slot")
    pairs = pitman_yor.Pairs(ask, slots)
    chance = model.chances(answers, totals, pairs.pair_word, pairs.context)
    number = {int(h): k for k, h in enumerate(pairs.hashes)}
    vocabulary = common.Vocabulary()
    vocabulary.encode([" ".join([*words, "never"])])
    of = {w: number[int(h)] for w, h in zip([*words, "never"], vocabulary.hashed(), strict=True)}
    (end,) = set(number.values()) - set(of.values())
    for before in (*of.values(), end):
        context = int(pairs.hashes[before] % np.uint64(pitman_yor.CONTEXTS))
        there = {int(w): c for w, g, c in zip(pairs.pair_word, pairs.context, chance, strict=True) if g == context}
        # Words that were never asked after this context have the chance of the parent alone, which the model gives, too.
        if len(there) == len(of) + 1:
            assert sum(there.values()) == pytest.approx(1, abs=1e-5)
    assert sum(int(pairs.hashes[b] % np.uint64(pitman_yor.CONTEXTS)) in set(pairs.context.tolist()) for b in of.values()) == 13


def test_a_repeated_document_is_likelier_than_its_words(spark):
    texts = [filler(k, 6) for k in range(300)] + [filler(k, 6) for k in range(20)]
    rows = {r.doc_id: r for r in pitman_yor.score(docs(spark, *texts, first=0)).collect() if not r.held_out}
    twice = [r.score / r.n_tokens for i, r in rows.items() if i < 20 and i + 300 in rows]
    once = [r.score / r.n_tokens for i, r in rows.items() if 20 <= i < 300]
    assert min(twice) > np.quantile(once, 0.9)


def test_scores_do_not_depend_on_how_rows_and_words_are_dealt(spark):
    """Totals of restaurants come from all words at each sweep, not from a slot's share: 1 or 13 partitions, equal scores."""
    texts = [filler(k % 90, 5) for k in range(120)] + [None, ""]
    table = docs(spark, *texts, first=0)
    few, many = ({r.doc_id: r for r in pitman_yor.score(table.repartition(n)).collect()} for n in (1, 13))
    assert few == many


def test_a_slot_among_others_seats_as_if_it_were_the_only_one():
    """All sweeps over three slots with their totals added up against the same sweeps over one slot of all words."""
    import pandas as pd

    random = np.random.default_rng(8)
    texts = [" ".join(random.choice([f"w{i}" for i in range(12)], 40)) + " " + filler(k % 40, 2) for k in range(60)]
    model, at = pitman_yor.Model(), {}
    for slots in (1, 3):
        requests = pd.concat([b.to_pandas() for b in pitman_yor._request(0, texts, [True] * 60, slots)])
        opened = {s: model.opened(g) for s, g in requests.groupby("slot")}
        last, kept = dict(opened), {}
        for k in range(model.sweeps):
            ends = pd.concat(list(last.values())).query("part < 0").groupby("part").totals.apply(lambda t: np.sum(list(t), axis=0))
            totals = np.concatenate([ends[x] for x in sorted(ends.index, reverse=True)])
            last = {s: model.seated(pd.concat([opened[s], last[s]] if k else [opened[s]]).query("part == 0"), k, totals) for s in opened}
        for s in opened:
            words, word, context, count = pitman_yor._pairs(opened[s].query("part == 0"))
            t = pitman_yor._unpacked(list(last[s].query("part == 0").t), np.uint32)[0]
            kept |= {(int(words[w]), int(g)): (int(c), int(n)) for w, g, c, n in zip(word, context, count, t, strict=True)}
        at[slots] = kept
    assert at[1] == at[3] and any(c > n > 1 for c, n in at[1].values())


def test_draws_by_hash_follow_their_distributions():
    keys = np.arange(20_000, dtype=np.uint64)
    draws, random = pitman_yor.Draws(keys, 17, 0), np.random.default_rng(2)
    u = draws.random(len(keys))
    assert 0 < u.min() and u.max() < 1 and np.quantile(u, [0.1, 0.5, 0.9]) == pytest.approx([0.1, 0.5, 0.9], abs=0.02)
    for n, chance in ((2, 0.4), (30, 0.9), (500, 0.01)):
        got, want = draws.binomial(np.full(len(keys), n), np.full(len(keys), chance)), random.binomial(n, chance, len(keys))
        assert got.mean() == pytest.approx(n * chance, abs=0.05 + 0.01 * n * chance) and got.std() == pytest.approx(want.std(), rel=0.05) and got.max() <= n
    customers = np.full(3000, 5000)
    assert pitman_yor.seat(customers, np.full(3000, 0.5), 0.8, pitman_yor.Draws(keys[:3000], 1, 1)).mean() == pytest.approx(pitman_yor.seat(customers, np.full(3000, 0.5), 0.8, random).mean(), rel=0.03)


def test_seatings_stay_between_bounds():
    random = np.random.default_rng(1)
    customers = np.sort(np.r_[np.ones(50, np.int64), random.integers(2, 5000, 200)])[::-1]
    tables = pitman_yor.seat(customers, np.full(len(customers), 0.5), 0.8, random)
    for n in (40, 5000):  # the mean number of tables of one dish against customers seated one by one
        plain, many = [], pitman_yor.seat(np.full(3000, n), np.full(3000, 0.5), 0.8, random).mean()
        for _ in range(60):
            t = 1
            for k in range(1, n):
                t += random.random() < 0.5 / (0.5 + k - 0.8 * t)
            plain.append(t)
        assert many == pytest.approx(np.mean(plain), abs=4 * np.std(plain) / 60**0.5 + 0.02)
    assert (tables >= 1).all() and (tables <= customers).all() and tables[customers == 1].max() == 1


def test_scores_of_odd_rows(odd, empty):
    rows = pitman_yor.score(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2, 3)} == {1}
    assert pitman_yor.score(empty).count() == 0


# ---- 4 substring dedup ---------------------------------------------------------

PASSAGE = (
    "The harbour was quiet before dawn, and the boats lay still on the water. Nobody on the pier spoke of the storm that had passed. "
    "Two men carried nets to the wall and laid them out to dry. A gull walked along the edge as if it owned the place. Then the bell rang once."
)


def filler(seed, n=8):
    random = np.random.default_rng(seed)
    return " ".join(" ".join(f"w{random.integers(1 << 30)}" for _ in range(9)).capitalize() + "." for _ in range(n))


def test_repeated_passage_is_cut_after_its_first_place(spark):
    texts = [filler(1) + " " + PASSAGE + " " + filler(2), filler(3) + " start of " + PASSAGE + " " + filler(4), filler(5), PASSAGE]
    got = {r.doc_id: r.text for r in spans.deduplicated(docs(spark, *texts)).collect()}
    assert got[1] == texts[0] and got[3] == texts[2]
    assert "Two men carried nets" not in got[2] and got[2].startswith(filler(3)) and got[2].rstrip().endswith(filler(4))
    assert "Two men" not in got[4]


def brute_ranges(texts, k=3, words=25, near=9):
    """Runs by their words, cut where a window of words has its least value; positions that repeat an earlier run."""
    first, found = {}, collections.defaultdict(set)
    for doc, text in sorted(texts.items()):
        places = [m.span() for m in re.finditer(r"\S+", text)]
        plain = [text[a:b] for a, b in places]
        value = []
        for i, (a, b) in enumerate(places):
            behind = text[b : places[i + 1][0] if i + 1 < len(places) else len(text)]
            final = text[b - 1] in ".!?" or bool(set(behind) & set("\n\r\v\f"))
            value.append((not final, int(spans.words_at(text[a:b])[2][0]) >> 1))
        cuts = {i for s in range(len(plain) - near + 1) for i in range(s, s + near) if value[i] == min(value[s : s + near])} | {len(plain) - 1}
        cuts = sorted(cuts) if plain else []
        for i, s in enumerate([0, *(c + 1 for c in cuts[:-1])] if plain else []):
            last = next((c for j, c in enumerate(cuts) if c >= s + words - 1 and j >= i + k - 1), None)
            if last is None:
                continue
            key = tuple(plain[s : last + 1])
            if first.setdefault(key, (doc, s)) != (doc, s):
                found[doc].update(range(places[s][0], places[last + 1][0] if last + 1 < len(places) else len(text)))
    return found


def test_ranges_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_ranges({r.doc_id: r.text for r in table.orderBy("doc_id").collect()})
    got = collections.defaultdict(set)
    for r in spans.repeated_ranges(table.repartition(7)).collect():
        got[r.doc_id].update(*(range(x.start, x.end) for x in r.ranges))
    assert dict(got) == dict(want) and len(want) > 10


def test_rows_of_one_id(spark):
    rows = [(1, filler(1) + " " + PASSAGE), (2, filler(2)), (2, PASSAGE + " " + filler(3)), (2, PASSAGE + " " + filler(3)), (3, filler(4))]
    got = sorted(tuple(r) for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [i for i, _ in got] == [i for i, _ in rows] and {(1, rows[0][1]), (2, rows[1][1]), (3, rows[4][1])} <= set(got)
    assert got[1] == got[2] or got[2] == got[3], "equal rows stay equal"
    assert all("Two men" not in t for i, t in got if i == 2)


def test_long_text_in_blocks():
    text = (PASSAGE + "\n") * 40
    for block in (50, 777):
        for x, y in zip(spans.words_at(text), spans.words_at(text, block), strict=True):
            assert (x == y).all()


def sentences(random, *sizes):
    return " ".join(" ".join(f"s{random.integers(1 << 30)}" for _ in range(n)).capitalize() + "." for n in sizes)


@pytest.mark.parametrize("seed", range(3))
def test_every_passage_of_over_50_words_is_caught(spark, seed):
    random = np.random.default_rng(seed)
    forms = [(28, 28), (17, 20, 18), (51,), (60,), (26, 25), (9, 42), (42, 9), (8, 9, 9, 8, 9, 8), (10, 10, 10, 10, 11), (5, 38, 8), (20, 21, 10)]
    texts, passages = [], []
    for sizes in forms:
        for before, after in (("", ""), ("w", ""), ("w w w w w w w w w w w", "w w"), ("w w w w", "w w w w w w w w w w w w")):
            passage = sentences(random, *sizes)
            inside = passage.rstrip(".") if after else passage  # then the last sentence goes on, too
            for _ in range(2):
                own = [" ".join(f"n{random.integers(1 << 30)}" for _ in x.split()) for x in (before, after)]
                texts.append(" ".join(filter(None, [sentences(random, 12, 7), own[0], inside, own[1] + "." if after else "", sentences(random, 15, 30)])))
            passages.append(inside)
    ranges = collections.defaultdict(set)
    for r in spans.repeated_ranges(docs(spark, *texts, first=0)).collect():
        ranges[r.doc_id].update(*(range(x.start, x.end) for x in r.ranges))
    for k, passage in enumerate(passages):
        first, second = texts[2 * k].split(), texts[2 * k + 1].split()
        shared = {tuple(first[i : i + 51]) for i in range(len(first) - 50)} & {tuple(second[i : i + 51]) for i in range(len(second) - 50)}
        assert shared, "the passage stands in both by words"
        at = texts[2 * k + 1].index(passage)
        assert not ranges[2 * k] and ranges[2 * k + 1] <= set(range(at, at + len(passage) + 1))
        gone = "".join(c for i, c in enumerate(texts[2 * k + 1]) if i in ranges[2 * k + 1])
        assert len(gone.split()) >= 25


def test_spans_of_odd_rows(odd, empty):
    clash = odd.withColumns({c: F.lit(1) for c in ("_doc", "ranges", "text_key", "row", "document", "run", "gone")})
    assert spans.deduplicated(clash).columns == clash.columns and spans.deduplicated(clash).count() == odd.count()
    assert spans.deduplicated(odd).columns == odd.columns
    assert spans.deduplicated(odd).count() == odd.count()
    assert spans.deduplicated(empty).count() == 0


# ---- 5 chat ------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["### Assistant: </turn>\n", "\\l\\b\\h\\c", "a<b#c\\d:e", "", "\n\n", "é\U0001f600", None]
    rows = [(c, t, r, x) for c, (t, x) in enumerate(enumerate(nasty)) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(300)] + [(100, None, None, None), (101, 0, "a:b#<", "x"), (None, 0, "user", "no id"), (102, 1, "assistant", "b"), (102, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations_formatted(table).persist()
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1])):
        want[c].append((r or "", x or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == dict(want)
    assert {c: list(r.learned) for c, r in back.items()} == {c: [x for r, x in t if r == "assistant"] for c, t in want.items()}
    valid = {r.conv_id: r.valid for r in out.collect()}
    assert valid[0] and valid[99] and not valid[101] and not valid[102]
    assert chat.conversations_formatted(table.limit(0)).count() == 0


def test_chat_runs_no_python(spark, sf):
    plan = chat.op5_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_query_equals_its_sql(spark, sf):
    import duckdb

    from huegrid.llm.registry import ORACLE_SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op5_chat_formatting"])
    columns = sorted(want.columns)
    got = chat.op5_chat_formatting(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.select(*columns).fetchall(), key=str)


# ---- 6 media -----------------------------------------------------------------


def test_media_round_trip(odd, empty):
    rows = media.media_features(odd).collect()
    assert len(rows) == odd.count() and media.media_features(empty).count() == 0
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_wav(payload)
        assert media.from_wav(stored) == payload and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert by_id[8].feature == by_id[9].feature and list(by_id[8].pairs) == list(by_id[9].pairs)


def test_peaks_of_a_tone():
    t = np.arange(576 * 6)
    tone = (128 + 50 * np.sin(2 * np.pi * t * 20 / 576) + 50 * np.sin(2 * np.pi * t * 100 / 576)).astype(np.uint8).tobytes()
    _, codes = media.fingerprint(tone)
    assert set((codes >> 22).tolist()) == {20, 100}


# ---- 7 toxicity --------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark, sf):
    at = sf.replace("0.001", "0.01")
    rows = toxicity.op7_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hits = [r.score for r in held if r.toxic == 1]
    others = [r.score for r in held if r.toxic == 0]
    better = np.mean([a > b for a in hits for b in others])
    assert len(hits) >= 5 and better > 0.75
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_features_are_those_of_the_kernel():
    """The product of two feature vectors against the kernel summed over all pairs of subsequences."""
    import itertools

    def counts(word):
        text, out = "\x02" + word + "\x03", collections.Counter()
        for i, j, k in itertools.combinations(range(len(text)), 3):
            if k - i < toxicity.SPAN:
                out[text[i], text[j], text[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idi-ot", "i.d.i.o.t", "harbour", "a", "aaaaaa", "abcabcabcabcabcabcabcabc"]
    row, code, value = toxicity._features([w.encode() for w in words])
    norms = toxicity._norms(toxicity.word_matrix([w.encode() for w in words])[0])
    vectors = np.zeros((len(words), toxicity.N_CODES))
    np.add.at(vectors, (row, code), value * norms[row])
    for a, b in itertools.product(range(len(words)), repeat=2):
        x, y = counts(words[a]), counts(words[b])
        if "-" not in words[a] + words[b] and "." not in words[a] + words[b]:  # symbols share a code
            assert vectors[a] @ vectors[b] == pytest.approx(sum(v * y[k] for k, v in x.items()))
    assert vectors[0] @ vectors[1] / np.linalg.norm(vectors[0]) / np.linalg.norm(vectors[1]) > 0.5


def test_long_words_are_learned_whole():
    weights = np.zeros(toxicity.N_CODES, np.float32)
    row, code, _ = toxicity._features([b"idiot"])
    weights[code] = 1
    long = b"q" * 60 + b"idiot" + b"z" * 30
    assert set(code) & set(toxicity._features([long], weights)[1]) and not set(code) & set(toxicity._features([long])[1])


def test_gapped_and_inserted_insults():
    random = np.random.default_rng(4)
    words = ["".join(random.choice(list("aeinorst"), random.integers(3, 9))) for _ in range(600)]
    texts, labels = [], []
    for i in range(240):
        body = list(random.choice(words, 30))
        if i % 3 == 0:
            body[random.integers(30)] = random.choice(["grumblewit", "blockhead"])
        texts.append(" ".join(body) + ".")
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    margin = dict(zip(("grumblewit", "g.rumble-wit", "grumb1ewit###", "block-head", "rosten"), model.margins([b"grumblewit", b"g.rumble-wit", b"grumb1ewit###", b"block-head", b"rosten"]), strict=True))
    assert margin["rosten"] < 0 < margin["grumblewit"]
    assert min(margin["g.rumble-wit"], margin["grumb1ewit###"], margin["block-head"]) > margin["rosten"]
    assert "blockhead" in toxicity.joined_spacing("you b l o c k h e a d you")


def test_toxicity_of_odd_rows(spark, odd, empty):
    model = toxicity.fit(["nice words here", "awful blockhead here"] * 10, [0, 1] * 10)
    scored = toxicity.with_score(odd, model, "s_")
    assert scored.columns == [*odd.columns, "s_"] and scored.count() == odd.count()
    assert toxicity.with_score(empty, model, "s_").count() == 0
    assert toxicity.fit([], []).constant == 0.0 and toxicity.fit(["a"], [1]).constant == 1.0


# ---- 8 near join -------------------------------------------------------------


def shingles(text):
    w = common.words_of(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_components(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in texts}


def near_copies(seed=0):
    random, texts = np.random.default_rng(seed), []
    for size in (4, 9, 10, 11, 12, 13, 18, 19, 40, 41, 150, 400):
        base = [f"v{random.integers(5000)}" for _ in range(size)]
        for _ in range(6):
            copy = list(base)
            for _ in range(random.integers(0, max(2, size // 20))):
                copy[random.integers(len(copy))] = f"n{random.integers(5000)}"
            if random.random() < 0.5:
                copy += [f"e{random.integers(5000)}" for _ in range(random.integers(0, 3))]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(spark, seed):
    texts = dict(enumerate([*near_copies(seed), "", None, "one", "one", "one two"], 1))
    rows = near_join.jaccard_groups(docs(spark, *texts.values())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_blocking_loses_no_linkable_pair():
    random = np.random.default_rng(8)
    for n in (9, 10, 17, 18, 30, 100, 300, 900):
        for _ in range(40):
            a = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64))
            away = random.integers(0, max(1, len(a) // 10) + 1)
            grown = len(a) // 20
            b = np.unique(np.r_[random.permutation(a)[away:], random.integers(0, 1 << 63, grown, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(a) != both:
                assert np.intersect1d(near_join.block_keys(a, 90), near_join.block_keys(b, 90)).size


def test_components_of_chains_and_stars(spark):
    random = np.random.default_rng(9)
    names = random.permutation(400)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(150)] + [(int(names[200]), int(names[i])) for i in range(201, 260)] + [(7000, 7000)]
    got = {r.node: r.label for r in near_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    chain, star = min(names[:151]), min(names[200:260])
    want = {int(n): int(chain) for n in names[:151] if n != chain} | {int(n): int(star) for n in names[200:260] if n != star}
    assert got == want
    assert near_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_of_odd_rows(odd, empty):
    rows = near_join.jaccard_groups(odd).collect()
    assert len(rows) == odd.count() and near_join.jaccard_groups(empty).count() == 0
    got = {r.doc_id: r.component_id for r in rows}
    assert got[8] == got[9] == 8 and got[None] is None and got[0] == 0 and got[1] == 1


# ---- 9 decontamination -------------------------------------------------------


def test_items_are_found_and_clean_documents_are_not(spark):
    items = ["".join(filler(100 + k, 4)) for k in range(12)]
    words = items[3].split()
    swapped = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))
    texts = [filler(1) + " " + items[0].upper() + " " + filler(2), filler(3), filler(4) + "\n" + swapped, items[5], filler(6) + " " + " ".join(words[:9]), *(filler(k) for k in range(200, 260))]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, *texts), bench).collect()}
    assert got == {(1, 0), (3, 3), (4, 5)}


def test_short_items_are_found_wherever_they_start(spark):
    random = np.random.default_rng(12)
    usual = [f"u{k}" for k in range(60)]
    items = [" ".join(f"w{random.integers(400)}" if random.random() < 0.7 else random.choice(usual) for _ in range(n)) for n in (8, 9, 11, 12, 13, 17, 20, 24)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for offset in range(8):
            for dropped in (0, 1):
                words = item.split()
                if dropped:
                    del words[len(words) // 3]
                before = [str(random.choice(usual)) if random.random() < 0.5 else f"w{random.integers(400)}" for _ in range(40 + offset)]
                after = [str(random.choice(usual)) if random.random() < 0.5 else f"w{random.integers(400)}" for _ in range(30)]
                texts.append(" ".join([*before, *words, *after]))
    for d, text in enumerate(texts, 1):
        words = decontamination.plain_words(text)
        for k, item in enumerate(items):
            own = decontamination.plain_words(item)
            width = len(own) + len(own) // 2
            if any(decontamination.common_subsequence(own, words[i : i + width]) >= 0.6 * len(own) for i in range(len(words))):
                want.add((d, k))
    assert {((k * 8 + o) * 2 + c + 1, k) for k in range(len(items)) for o in range(8) for c in (0, 1)} <= want
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, *texts), bench).collect()}
    assert want <= got


def test_latent_space_is_that_of_all_documents(spark):
    table = docs(spark, *(filler(k % 45, 3) + " " + filler(k // 2, 2) for k in range(90)))
    texts = [r.text for r in table.collect()]
    columns = decontamination.Columns(texts[::3])
    idf = decontamination.inverse_frequencies(table, columns)
    space = decontamination.latent_space(table, columns, idf)
    frequency = collections.Counter(w for t in texts for w in set(decontamination.plain_words(t)))
    dense = []
    for text in texts:
        words = decontamination.plain_words(text)
        for k in range(0, len(words), decontamination.PASSAGE):
            row = np.zeros(columns.size)
            for w in words[k : k + decontamination.PASSAGE]:
                if w in columns.of:
                    row[columns.of[w]] += max(0.05, math.log((1 + len(texts)) / (1 + frequency[w])))
            dense.append(row / max(np.linalg.norm(row), 1e-9))
    top = np.linalg.svd(np.array(dense), compute_uv=False)[: decontamination.RANK]
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    assert np.linalg.norm(np.array(dense) @ space) ** 2 >= 0.95 * (top**2).sum()


def test_recall_against_all_windows(spark, sf):
    """Every document and item that the exact checks accept in some window, whatever its cosine, is found, paraphrases included."""
    random = np.random.default_rng(8)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    for k, item in items.items():
        words = item.split()
        for lost in (0.0, 0.2, 0.35):  # words left out or replaced
            said = [w if random.random() >= lost else f"x{random.integers(99)}" for w in words if random.random() >= lost / 3]
            base = (texts[k % 60] or "").split()[:120]
            at = random.integers(0, len(base) + 1)
            texts.append(" ".join([*base[:at], *said, *base[at:]]))
    want = set()
    for d, text in enumerate(texts, 1):
        words = decontamination.plain_words(text)
        for k, item in items.items():
            own = decontamination.plain_words(item)
            answer = own[len(own) - len(decontamination.plain_words(decontamination.ANSWER.split(item.strip())[-1])) :]
            n, there = len(own), set(own)
            near = [i for i in range(len(words)) if words[i] in there]
            for i in near if len(near) >= 0.6 * n else ():
                window = words[i : i + n + n // 2]
                if decontamination.common_subsequence(own, window) >= 0.6 * n and 2 * decontamination.common_subsequence(answer, window) >= len(answer):
                    want.add((d, k))
                    break
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, *texts), bench).collect()}
    assert len(want) >= len(items) and len(got & want) >= 0.98 * len(want)


def test_common_subsequence():
    random = np.random.default_rng(2)
    for _ in range(50):
        a, b = random.integers(0, 5, random.integers(0, 20)).tolist(), random.integers(0, 5, random.integers(0, 20)).tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


# ---- 10 secrets --------------------------------------------------------------


def test_secrets_are_found_and_lookalikes_are_not(spark, sf):
    at = sf.replace("0.001", "0.01")
    table = spark.read.parquet(f"{at}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    want = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"|password=([0-9a-f]{18})', t) if m[1]}
    want |= {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r"(?i)password=([0-9a-f]{18})", t)}
    got = {(r.doc_id, r.start) for r in secrets.op10_secret_scan(spark, at).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want) + 1


def test_precision_and_recall_on_planted_findings(spark):
    """Secrets and lookalikes that the training has not seen (another seed and forms of its own), in documents."""
    held = secrets.made_findings(n=20, seed=99)
    held += [("Tr0ub4dor&3xxYYzz", 'password = "', '"', "", 1), ("hunter2!Q9", "passwd=", " ", "", 1), ("q7GhT2mLp0Zr8YxW4vBn6Kd1", "see ", " ", "", 1)]
    held += [("3f786850e387550fdab836ed7e6dc881de23001b", "commit ", " ", "", 0), ("123e4567-e89b-12d3-a456-426614174000", "uuid: ", " ", "", 0), ("getElementsByClassName", "call ", " ", "", 0)]
    table = spark.createDataFrame([(k, f"{filler(k, 2)} {b}{c}{a} {filler(k + 7, 2)}", p) for k, (c, b, a, p, _) in enumerate(held)], "doc_id long, text string, source string")
    found = collections.defaultdict(list)
    for r in secrets.secrets(table, *secrets.model_of(table)).collect():
        found[r.doc_id].append(r)
    label = np.array([h[4] for h in held])
    hit = np.array([k in found for k in range(len(held))])
    assert (hit & (label == 1)).sum() >= 0.93 * label.sum(), "recall"
    assert (hit & (label == 1)).sum() >= 0.93 * hit.sum(), "precision"
    assert hit[-6:].tolist() == [True, True, True, False, False, False]


def test_secrets_of_odd_rows(odd, empty):
    model = secrets.model_of(odd)
    assert secrets.secrets(odd, *model).count() == 0 and secrets.redacted(odd, *model).count() == odd.count()
    assert secrets.secrets(empty, *secrets.model_of(empty)).count() == 0


def test_redaction(spark, odd, empty):
    body = "0123456789abcdef0123456789ABCDEF01234567"
    texts = [f'here token = "{body}" ends', f"commit {body}", "https://example.com/some/long/path/to/a/page1", None, ""]
    findings = spark.createDataFrame([(f"{i:040x}"[::-1].replace("0", "f"), 'token = "', '"', 1) for i in range(1000, 1040)] + [(f"{i:040x}"[::-1].replace("0", "f"), "commit ", " ", 0) for i in range(1000, 1040)], "candidate string, before string, after string, label int")
    usual, forest = secrets.model_of(docs(spark, *texts), findings)
    got = [r.text for r in secrets.redacted(docs(spark, *texts), usual, forest).orderBy("doc_id").collect()]
    assert got == ['here token = "[SECRET]" ends', texts[1], texts[2], None, ""]
    assert secrets.redacted(odd, usual, forest).columns == odd.columns
    assert secrets.secrets(empty, usual, forest).count() == 0 and secrets.redacted(empty, *secrets.model_of(empty)).count() == 0


def test_forest_learns_a_rule():
    random = np.random.default_rng(6)
    x = random.random((600, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    forest = secrets.Forest().fit(x[:400], y[:400])
    assert ((forest.predict(x[400:]) >= 0.5) == y[400:]).mean() > 0.93
