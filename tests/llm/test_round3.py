"""The operators 11 to 13, items that most documents hold, hostile and commented pages, against plain versions and odd rows."""

import collections
import hashlib
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from huegrid.llm import alignment, decontamination, html_text, merkle, quality_rules
from huegrid.llm.packing import _byte_of

ODD = [None, "", " ", "  ", "a", "a ", "  a  b ", "\n\n a\n", "x▁y", "<|endoftext|> a </s><s> <unk>", "naïve 日本語のテキスト 🙂🙂", "=" * 600, "\x1c b\x85 c d", "don't  can't\t\tx", "é" * 50, "ab " * 3, "1234567890" * 7, "<0x0A>\n\n\n   \t  z"]
CLASHING = "words string, w string, l string, n_words string, base_failed string, rejected_by string, pairs string, links string, row string, tree string, at string, digest string, place string, part string, same string, before string, path string, above string, total string, block string"


def rows_of(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "the cat", None, "s1", None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        more = CLASHING.split(", ")
        return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], f"{names}, {CLASHING}").repartition(3)
    return spark.createDataFrame(rows, names).repartition(3)


def ordered(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def by_sql(spark, docs, sql, columns):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    return sorted(con.sql(sql).select(", ".join(columns)).fetchall(), key=str)


# ---- 9 items that many documents hold -----------------------------------------


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 1), (3, 1), (3, 3), (10, 5), (10, 10), (40, 25)])
def test_an_item_is_found_however_many_documents_hold_it(spark, n, k):
    item, chance = "which planet of the solar system has the largest number of known moons. saturn has them all", random.Random(n)
    junk = lambda: " ".join(chance.choice("lorem ipsum dolor sit amet the of".split()) for _ in range(60))
    docs = spark.createDataFrame([(i, f"{junk()} {item} {junk()}" if i < k else junk()) for i in range(n)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contaminated(docs, bench).collect()) == list(range(k))


# ---- 11 quality rules --------------------------------------------------------

COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    good = "the quick brown fox went over to the old house and it was there that we saw " + " ".join(f"word{i} of" for i in range(60))
    return [*ODD, good, good + "\n" + good, good.upper(), " | ".join(["item"] + good.split()), "a b c a b c a b c x y a b", "x x x x", "l\n\nl\n \nl\n", "12 " * 60 + good[:200], "…\n" * 60 + good, "a#b*c " * 70]


def test_counts_equal_plain_ones(spark):
    docs = rows_of(spark, quality_texts())
    got = quality_rules.judged(docs, order=[r.name for r in quality_rules.rules()])
    want = sorted(((r.doc_id, *plain_counts(r.text)) for r in docs.collect()), key=str)
    assert ordered(got, *COUNTS[:6]) == want


def test_what_is_kept_does_not_depend_on_the_order(spark):
    docs, names = rows_of(spark, quality_texts()), [r.name for r in quality_rules.rules()]
    want = by_sql(spark, docs, quality_rules.OP11_SQL, COUNTS)
    for order in (names, names[::-1], None):
        assert ordered(quality_rules.judged(docs, order=order), *COUNTS) == want
    assert ordered(quality_rules.judged(rows_of(spark, quality_texts(), extra=True), order=names), *COUNTS) == want
    assert any(r[-1] for r in want)


def test_rules_go_by_rejections_per_second_of_what_is_left():
    rejected = [(frozenset("ab"), 50), (frozenset("b"), 10), (frozenset("c"), 5), (frozenset(), 35)]
    found = quality_rules.ordered({"a": 1.0, "b": 2.0, "c": 0.1, "d": 9.0, "e": 3.0}, rejected)
    assert [e.name for e in found] == ["a", "c", "b", "e", "d"]  # a and c have 50 for each second; b has 10 left once a is through
    assert [round(e.after, 3) for e in found[:3]] == [0.5, 0.1, round(10 / 45, 3)]


def test_later_rules_are_not_evaluated(spark):
    from pyspark.sql import functions as F

    docs = rows_of(spark, ["one two"])
    never = quality_rules.Rule("never", F.raise_error(F.lit("evaluated")).cast("boolean"))
    some = [quality_rules.Rule("all", F.col("n_words") >= 0), never]
    assert {r.rejected_by for r in quality_rules.judged(docs, some, order=["all", "never"]).collect()} == {"base"}
    with_words = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert {r.rejected_by for r in quality_rules.judged(with_words, some, order=["all", "never"]).collect()} == {"all"}


def test_quality_of_no_rows_and_no_python(spark):
    none = rows_of(spark, ["a"]).where("false")
    assert quality_rules.judged(none).collect() == []
    plan = quality_rules.judged(rows_of(spark, ["a"]).select("doc_id", "text"), order=["symbols"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange.*hash", plan)


# ---- 12 alignment --------------------------------------------------------------

LINKS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, byte_of, docs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), _byte_of(), []
    for doc, text in rows:
        sides = [], []
        if text:
            sides = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [
                (i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]
            ]
            if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
                sides = [], []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in sides]
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for (i, _), e in zip(side, end, strict=True) if start < e <= cut] for side, end in zip(sides, ends, strict=True)])
            start = cut
        docs.append((doc, len(sides[0]), len(sides[1]), groups))
    counts, best = collections.Counter(), collections.Counter()
    for *_, groups in docs:
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc, n_a, n_b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_links_equal_plain_ones(spark, sf, most):
    for docs in (rows_of(spark, ODD, extra=True), spark.read.parquet(f"{sf}/documents.parquet").limit(40)):
        want = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
        assert ordered(alignment.token_links(docs, broadcast_pairs=most), *LINKS) == want


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_of_no_rows(spark, most):
    assert alignment.token_links(rows_of(spark, ["a"]).where("false"), broadcast_pairs=most).collect() == []


def test_lockstep_and_slices_equal_merging_one_by_one():
    chance = np.random.default_rng(3)
    lengths = np.arange(5), np.arange(7)  # a token's id is its length
    sides, starts, want = ([], []), ([0], [0]), []
    for _ in range(30):
        size = int(chance.integers(0, 40))
        ends = []
        for side, most, start in zip(sides, (4, 6), starts, strict=True):
            tokens, left = [], size
            while left:
                tokens.append(int(chance.integers(1, min(most, left) + 1)))
                left -= tokens[-1]
            side.extend(tokens)
            start.append(start[-1] + len(tokens))
            ends.append((tokens, np.cumsum(tokens).tolist()))
        cuts = sorted(set(ends[0][1]) & set(ends[1][1]))
        groups = [[[t for t, e in zip(*side, strict=True) if low < e <= high] for side in ends] for low, high in zip([0, *cuts], cuts, strict=False)]
        want.append(collections.Counter((a, b) for p, q in groups for a in p for b in q))
    x = alignment.aligned(np.array(sides[0]), np.array(sides[1]), np.array(starts[0]), np.array(starts[1]), lengths)
    for most in (1, 5, 1 << 20):
        got = [collections.Counter() for _ in want]
        for _, _, doc, pair in alignment.links(x, 7, most):
            for d, p in zip(doc.tolist(), pair.tolist(), strict=True):
                got[d][divmod(p, 7)] += 1
        assert got == want


# ---- 13 manifest ---------------------------------------------------------------

PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_its_sql(spark, height):
    docs = rows_of(spark, [*ODD, *(f"text\n{i}" for i in range(40))])
    want = by_sql(spark, docs, merkle.OP13_SQL, PROOF)
    assert ordered(merkle.verified(docs, height), *PROOF) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_ignores_other_columns(spark):
    assert ordered(merkle.verified(rows_of(spark, ODD, extra=True)), *PROOF) == ordered(merkle.verified(rows_of(spark, ODD)), *PROOF)


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.verified(spark.createDataFrame([(7, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].verified
    assert one[0].leaf == hashlib.sha256(b"1:7---1:a").hexdigest() and one[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.verified(rows_of(spark, ["a"]).where("false")).collect() == []


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_addresses_are_a_layout_with_whole_subtrees(levels):
    every = [merkle.address(d, np.arange(3**d), levels) for d in range(levels)]
    assert sorted(np.concatenate(every).tolist()) == list(range((3**levels - 1) // 2))
    upper = max(levels // 2, 1)
    for top in range(3**upper if levels > upper else 0):  # each lower subtree lies in one run
        below = np.concatenate([every[d][top * 3 ** (d - upper) : (top + 1) * 3 ** (d - upper)] for d in range(upper, levels)])
        assert below.max() - below.min() + 1 == len(below) and below[0] == below.min()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26])
def test_paths_fold_to_the_root(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    for levels in (merkle.levels_of(n, True, 3), merkle.levels_of(n, False, 3)):
        block = merkle.build(leaves, levels)
        for digest, path in zip(leaves, merkle.paths(block, n, levels), strict=True):
            for level in path:
                digest = hashlib.sha256((level["before"] + digest + level["after"]).encode()).hexdigest()
            assert digest == block[:32].hex()


# ---- 10 bounds and long candidates ---------------------------------------------


@pytest.mark.parametrize("text", ["see a=b&token={}&c=d", "GET /x?user=joe&api_key={}", "A=1;TOKEN={};B=2", "url=https://host/path?key={}", 'x = "prefix:{}"', "list=[{}, other]", "token: {}."])
def test_a_token_has_its_own_bounds(text):
    from huegrid.llm import secrets

    token = "ghp_" + "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"
    found = {(at, body) for at, body, _, _ in secrets.candidates(text.format(token))}
    assert (text.index("{}"), token) in found and not any(token in body and body != token for _, body in found)


@pytest.mark.parametrize("body", ["x" + "_AaAaAaAaAaAaAaAa" * 20_000 + "!", "a" * 10**6, "ab/" * 300_000, "a.b-" * 250_000, "a@" * 500_000, "<" * 10**6, "A1b2" * 250_000, "eyJ" * 300_000, "xoxb-" * 200_000])
def test_a_candidate_of_a_megabyte_is_read_in_no_time(body):
    import time

    from huegrid.llm import secrets

    began = time.process_time()
    secrets.weak_label(body, "token = ")
    secrets.candidates("token = " + body)
    assert time.process_time() - began < 10


# ---- op2: long and hostile pages, comments inside articles ------------------------


@pytest.fixture(scope="module")
def labeller():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    return html_text.train(pages[:200])


@pytest.mark.parametrize("piece", ["<div x='", '<a "', '<a ">"', "<svg><g>", "<svg><desc>", "<b ", "<!", "<head><meta ", "<iframe =="])
def test_unclosed_tags_are_read_in_linear_time(piece):
    def seconds(n: int) -> float:
        start = time.perf_counter()
        html_text.blocks_of(piece * n)
        return time.perf_counter() - start

    assert min(seconds(20_000) for _ in range(2)) < 5  # quadratic reading took over 100 s


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p class='a>b'>one</p>two", ["one", "two"]),
        ("<p class='a>one</p>two", ["one", "two"]),
        ("<p>a<svg><g><text>no</text></g></svg>b</p>", ["ab"]),
        ("<p>a<svg><g>no<p>b", ["a", "b"]),
        ("<svg><svg></svg><p>x", ["x"]),
        ("<p>a < b and <x", ["a < b and <x"]),
        ("<p>a<!-- > <p>no", ["a"]),
    ],
)
def test_tags_and_drawings_end_where_they_should(page, text):
    assert [b.text for b in html_text.blocks_of(page)] == text


def test_stretches_give_the_scores_of_whole_pages(labeller, monkeypatch):
    random = np.random.default_rng(2)
    pages = [random.normal(size=(n, html_text.INPUT)).astype(np.float32) for n in (3, 50, 50, 700)]
    whole = labeller.logits(*html_text.padded(pages))
    there = html_text.padded(pages)[1]
    want = labeller.labels(pages)
    monkeypatch.setattr(html_text, "CELLS", 90)
    assert np.allclose(labeller.scores(pages)[there], whole[there], atol=1e-4)
    assert all((a == b).all() for a, b in zip(labeller.labels(pages), want, strict=True))


def test_one_long_page_does_not_widen_the_others(labeller):
    pages = [np.zeros((n, html_text.INPUT), np.float32) for n in (12_500, *[20] * 63)]
    tracemalloc.start()
    labeller.labels(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_comments_inside_an_article_go_and_the_text_stays(labeller):
    story = ["Rain over the hills", "Long clouds came in from the western sea and the town was wet by noon, said the keeper of the mill.", "The river rose by two metres. No one was hurt."]
    remarks = [
        "<section class='comments'><h2>Comments</h2><div class='comment'><p>Nice piece, thank you for writing it!</p></div><div class='comment'><p>I saw it from my window.</p></div></section>",
        "<div class='comments'><h3>2 comments</h3><ul><li><p>Nice piece.</p></li><li><p>I saw it from my window and it was not that bad at all.</p></li></ul></div>",
        "<section class='comments'><article class='comment'><p>Nice piece.</p></article></section>",
        "<div class='newsletter'><p>Sign up for our letters</p></div><form><label>Your name</label><button>Send</button></form>",
    ]
    main = f"<h1>{story[0]}</h1>" + "".join(f"<p>{t}</p>" for t in story[1:])
    pages = [f"<html><body><nav><a>Home</a></nav><{root}>{main}{r}</{root.split()[0]}><footer>All rights reserved</footer></body></html>" for root in ("article", "main", "div class='content'") for r in remarks]
    table = f"<html><body><table><tr><td class='menu'><a>News</a> <a>Sport</a></td><td>{main}</td></tr><tr><td class='footer'>All rights reserved</td></tr></table></body></html>"
    assert html_text.main_texts([*pages, table], labeller) == ["\n\n".join(story)] * (len(pages) + 1)
