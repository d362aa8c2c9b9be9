"""Secret scans: a random forest removes the false positives among secret-like strings.

Candidates are runs of ``LEAST`` or more characters of keys and tokens that mix letters and digits, or hold at least 20
characters with a change of case or a symbol, and assigned values (after ``=`` or ``:``, with or without quotes) of
``SHORT`` or more characters of any kind but white space and quotes that mix two kinds of characters. Each is described by
its length, its shares of character classes, transitions between them, entropy, dictionary coverage, whether it looks like a
path, address or number, the words beside it, and the document's path (its ``source``). Dictionary coverage is the share of
its letter triples that are usual ones: the triples that make up 99 % of the letter triples of all documents (counted over
the whole corpus).

The forest is trained from labelled findings: rows with candidate, before, after, path and label. Where none are given, they
come from two sides: ``made_findings``, drawn at random from the forms of real credentials and of what is mistaken for them,
with and without names beside them; and ``weak_label`` on the corpus itself, which takes known forms of tokens and random
values of named credentials for secrets, clear lookalikes (hashes of commits, addresses, UUIDs, words, placeholders) for
none, and leaves the rest unlabelled; at most ``sample`` findings of each label, the first by a hash of what they say. So
that no name alone decides, secrets that no hash looks like are learned without the words beside them, too. Every candidate
of every document is scored.

Defined results: null and empty texts hold no candidates; rows with a null id are scanned too; repeated rows give
repeated findings; a text of any length is scanned whole, and a candidate of any length is one; with findings of one label
only, every candidate gets that label; of training findings with equal hashes the first by text is taken; extra columns pass
through ``redacted`` unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import by_size, table, tidy, written

LEAST, SHORT, BESIDE = 16, 8, 32
RUN = re.compile(r"[A-Za-z0-9_+/=\-.~]{16,}")
#: A value in quotes reaches to the next quote or blank; a bare one ends at what parts the fields of a query string or a list, too.
ASSIGNED = re.compile(r"(?:[:=]|=>)[ \t]{0,2}(?:[\"'`](?!//)([^\s\"'`]{8,})|(?![\"'`]|//)([^\s\"'`&;,?]{8,}))")
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])|(?=.{20})(?=.*[a-z][A-Z]|.*[_+/=~])", re.DOTALL)
TWO_KINDS = re.compile(r"(?=.*[A-Za-z])(?=.*[^A-Za-z])|(?=.*[a-z])(?=.*[A-Z])|(?=.*[0-9])(?=.*[^0-9])", re.DOTALL)
#: What credentials are called.
NAMES = ("token", "secret", "passwd", "password", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
NAMED = re.compile(r"(?:" + "|".join(NAMES) + r")[\w\-]{0,16}[\"']?\s{0,2}(?:[:=]|=>|:=)\s{0,2}[\"']?$", re.I)
HINT = re.compile("|".join(NAMES), re.I)
HARMLESS = re.compile(r"(?:https?:|www\.|@|//|\b(?:commit|sha1?|sha256|md5|checksum|digest|uuid|id|ref|doi|isbn)\b)[^\s]{0,24}\s{0,2}[:=]?\s{0,2}[\"']?$", re.I)
#: Forms that issuers give their tokens.
FORMS = r"gh[pousr]_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9\-]{20,}+|[sr]k_live_[A-Za-z0-9]{20,}+|AIza[0-9A-Za-z_\-]{35}|eyJ[\w\-]{8,}+\.eyJ[\w\-]{8,}+\.[\w\-]{8,}+"
KNOWN, INSIDE = re.compile(rf"(?:{FORMS})$"), re.compile(rf"(?<![A-Za-z0-9_])(?:{FORMS})(?![A-Za-z0-9_])")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
PLACEHOLDER = re.compile(r"(?:your|example|changeme|placeholder|dummy|sample|xxxx|\*{3}|\$\{|%\(|\{\{|environ|getenv|process\.)", re.I)
#: Each starts at one character, so that a search reads a long candidate once.
ADDRESS = re.compile(r"(?:[a-z]://|www\.|[\w.\-]@[\w\-]++\.\w|[\w\-]/[\w\-]++/|[\w\-]\.(?:com|org|net|io|html?|py|java|js|md|txt|png|jpg)\b)", re.I)
NUMBER = re.compile(r"[\d.,:/TZ+\-_]+$")
IDENTIFIER = re.compile(r"[A-Za-z]++(?:[_\-.][A-Za-z]++)*+\d{0,2}$")
HEX = re.compile(r"[0-9a-fA-F]+$")
CONFIG = re.compile(r"\.(?:env|ya?ml|ini|cfg|conf|toml|properties|json|pem|key)$|config|settings|credential", re.I)
TEST = re.compile(r"test|example|sample|docs?/|fixture|spec", re.I)
KEY = 27**3


def candidates(text: str | None) -> list[tuple[int, str, str, str]]:
    """(position, candidate, before, after) of a text, assigned values first where runs overlap them; tokens of known forms inside a value stand for it."""
    if not text:
        return []
    spans = []
    for m in ASSIGNED.finditer(text):
        group = m.lastindex
        body, at = m[group].rstrip(".,;:)]}>"), m.start(group)
        known = [(at + k.start(), at + k.end()) for k in INSIDE.finditer(body)]
        if known:  # a token of a known form inside a longer value
            spans += known
        elif len(body) >= SHORT and TWO_KINDS.match(body):
            spans.append((at, at + len(body)))
    found, k = list(spans), 0
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            continue
        body = m.group().strip("=.-/~") or m.group()
        at = m.start() + m.group().find(body)
        if len(body) >= LEAST and MIXED.match(body):
            found.append((at, at + len(body)))
    return [(a, text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE]) for a, b in sorted(found)]


def _triples(word: str) -> list[int]:
    code = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in word.lower()]
    return [a * 729 + b * 27 + c for a, b, c in zip(code, code[1:], code[2:], strict=False) if a and b and c]


def describe(found: list[tuple[str, str, str, str | None]], usual: np.ndarray) -> np.ndarray:
    """One row of features for each (candidate, before, after, path)."""
    rows = []
    for body, before, after, path in found:
        path = path or ""
        n = len(body)
        kinds = "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else "-" for c in body)
        counts = Counter(body)
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        triples = _triples(body)
        changes = Counter(zip(kinds, kinds[1:], strict=False))
        moved = sum(v for (a, b), v in changes.items() if a != b)
        rows.append(
            (
                n,
                kinds.count("a") / n,
                kinds.count("A") / n,
                kinds.count("0") / n,
                kinds.count("-") / n,
                moved / n,
                sum(v for (a, b), v in changes.items() if {a, b} == {"a", "0"} or {a, b} == {"A", "0"}) / n,
                sum(v for (a, b), v in changes.items() if {a, b} == {"a", "A"}) / n,
                entropy,
                entropy / math.log2(max(2, n)),
                float(usual[triples].mean()) if triples else 0.0,
                len(triples) / n,
                float(bool(HEX.match(body))),
                float(body.count("/") + body.count(".")),
                float(body.count("_") + body.count("-")),
                max(len(x) for x in re.split(r"[^a-z]+", body.lower())) / n,
                float(bool(HINT.search(before))),
                float(bool(re.search(r"[:=]\s{0,2}[\"']?$", before))),
                float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(after[:1])),
                float(bool(HARMLESS.search(before))),
                float("@" in before[-20:] or after[:1] == "@"),
                max(len(m.group()) for m in re.finditer(r"(.)\1*", body, re.DOTALL)) / n,
                float(path.count("/")),
                float(bool(CONFIG.search(path) or CONFIG.search(before))),
                float(bool(TEST.search(path))),
                float(len(set(kinds))),
            )
        )
    return np.array(rows, np.float64).reshape(len(rows), 26)


class Forest:
    """Classification trees on bootstrap samples; each split is the best by Gini among a few features."""

    def __init__(self, trees: int = 24, depth: int = 8, seed: int = 5):
        self.size, self.depth, self.seed, self.trees = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        random = np.random.default_rng(self.seed)
        for _ in range(self.size):
            rows, tree = random.integers(0, len(x), len(x)), []
            self._grow(x[rows], y[rows], 0, tree, random)
            self.trees.append(np.array(tree))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int, tree: list, random: np.random.Generator) -> int:
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, float(y.mean())))
        if level >= self.depth or len(y) < 4 or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        whole = 2 * y.mean() * (1 - y.mean())
        for f in random.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.nonzero(v[1:] > v[:-1])[0]
            if not len(cut):
                continue
            left = cut + 1
            p, q = ones[cut] / left, (ones[-1] - ones[cut]) / (len(y) - left)
            gain = whole - (left * 2 * p * (1 - p) + (len(y) - left) * 2 * q * (1 - q)) / len(y)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            a = self._grow(x[low], y[low], level + 1, tree, random)
            b = self._grow(x[~low], y[~low], level + 1, tree, random)
            tree[at] = (best[1], best[2], a, b, tree[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = tree[node, 0].astype(np.int64)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= tree[node, 1], tree[node, 2], tree[node, 3]).astype(np.int64)
                node = np.where(f >= 0, go, node)
            total += tree[node, 4]
        return total / max(1, len(self.trees))


def placeholder(candidate: str) -> bool:
    """Whether it says that a secret belongs there, or has something in angle brackets."""
    return bool(PLACEHOLDER.search(candidate)) or -1 < candidate.find("<") < candidate.rfind(">")


def weak_label(candidate: str, before: str) -> int | None:
    """1 for clear secrets, 0 for clear lookalikes, None for the rest."""
    if KNOWN.match(candidate):
        return 1
    if placeholder(candidate) or ADDRESS.search(candidate) or any(p.match(candidate) for p in (UUID, NUMBER, IDENTIFIER)) or HARMLESS.search(before):
        return 0
    kinds = sum(bool(re.search(p, candidate)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(k / len(candidate) * math.log2(k / len(candidate)) for k in Counter(candidate).values())
    return 1 if NAMED.search(before) and kinds > 1 and entropy > 2.5 else None


def made_findings(n: int = 60, seed: int = 13) -> list[tuple[str, str, str, str, int]]:
    """candidate, before, after, path, label: ``n`` of each form of credentials and of what is mistaken for them."""
    random = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = ("user", "name", "value", "page", "index", "report", "data", "total", "winter", "harbour", "example", "project", "image", "table", "summer", "garden")

    def some(letters: str, least: int, most: int | None = None) -> str:
        return "".join(random.choice(list(letters), random.integers(least, (most or least) + 1)))

    def one(*values: str) -> str:
        return values[random.integers(len(values))]

    def named() -> tuple[str, str]:
        quote = one('"', "'", "", "")
        name = one("token", "API_TOKEN", "secret", "client_secret", "password", "db_password", "passwd", "api_key", "apiKey", "access_key", "auth_token")
        return f"{one('', 'export ', 'const ', '  ', 'the ')}{name}{one(' = ', '=', ': ')}{quote}", quote or one("", " ", "\n", ";")

    def bare() -> tuple[str, str]:
        return one("", f"{one(*words)} ", "Authorization: Bearer ", "see ", "with key "), one("", " ", "\n", ".")

    hexa, mixed, out = digits + "abcdef", lower + lower.upper() + digits, []
    tokens = (
        lambda: "gh" + one("p", "o", "s") + "_" + some(mixed, 36),
        lambda: "AKIA" + some(lower.upper() + digits, 16),
        lambda: "sk_live_" + some(mixed, 24, 32),
        lambda: "xoxb-" + some(digits, 12) + "-" + some(mixed, 24),
        lambda: "AIza" + some(mixed + "_-", 35),
        lambda: "eyJ" + some(mixed, 20, 40) + ".eyJ" + some(mixed, 30, 80) + "." + some(mixed + "_-", 43),
        lambda: some(mixed, 20, 64),
        lambda: some(mixed + "+/", 40, 64),
    )
    commit = lambda: f"{one('commit ', 'sha256: ', 'md5=', 'checksum = ', 'digest:', 'commit=', 'at ', 'in ', '')}{one('', chr(34))}"
    fake = (
        lambda: (some(hexa, *one((32, 32), (40, 40), (64, 64), (16, 20))), commit()),
        lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), one("id=", "uuid: ", "request ", 'key = "')),
        lambda: ("/".join(one(*words) for _ in range(random.integers(2, 6))) + one("", ".html", ".py", "/page-1"), one("https://", "see ", "path=", "file: ")),
        lambda: (f"{one(*words)}.{one(*words)}{some(digits, 0, 2)}@mail{some(digits, 1)}.example.com", one("", "to ", "mail: ")),
        lambda: (one(*words) + "".join(one(*words).capitalize() for _ in range(2)) + some(digits, 0, 2), one("= ", "call ", "token = ", "")),
        lambda: ("_".join(one(*words) for _ in range(4)) + some(digits, 0, 2), one("", "= ", "the ")),
        lambda: (f"20{some(digits, 2)}-0{some('123456789', 1)}-1{some(digits, 1)}T{some('01', 1)}{some(digits, 1)}:3{some(digits, 1)}:0{some(digits, 1)}Z", one("at ", "date: ", "time=")),
        lambda: (one("your-token-here", "<your-api-key>", "changeme123", "xxxxxxxxxxxx1", "${API_TOKEN}", "example_key_1234", "********1"), named()[0]),
        lambda: (one(*words) + "-" + one(*words) + one("", "1", "-v2"), one("mode = ", "name: ", "theme=", 'title = "')),
    )
    for _ in range(n):
        path = one("src/main.py", "app/.env", "config/settings.yml", "docs/readme.md", "tests/test_login.py", "")
        for token in tokens:
            body = token()
            out.append((body, *named(), path, 1))
            out.append((body, *bare(), path, 1))
        for length in ((18, 18), (32, 32), (40, 40), (64, 64)):
            out.append((some(hexa, *length), *named(), path, 1))
        for _ in range(2):
            out.append((one(*words).capitalize() + some(digits, 2, 4) + some("!@#$%&*^?", 1, 2) + some(mixed, 2, 8), *named(), path, 1))
        for k, lookalike in enumerate(fake):
            for _ in range(4 if k == 0 else 2):
                body, before = lookalike()
                out.append((body, before, one("", " ", "\n", '"'), path, 0))
    return [(c, b[-BESIDE:], a[:BESIDE], p, y) for c, b, a, p, y in out]


@tidy
def _evidence(batches: Iterator[pa.RecordBatch], labels: bool) -> Iterator[pa.RecordBatch]:
    """Rows triple, n (counts of letter triples) and rows candidate, before, after, path, label (each once in a batch)."""
    total = np.zeros(KEY, np.int64)
    letters = np.zeros(256, np.int64)
    letters[97:123] = letters[65:91] = np.arange(1, 27)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32()]
    names = ["triple", "n", "candidate", "before", "after", "path", "label"]

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in zip(names, kinds, strict=True)], names)

    for batch in batches:
        found = set()
        for part in by_size(batch.column("text")):
            texts = batch.column("text").slice(part.start, part.stop - part.start).to_pylist()
            data = np.frombuffer("\n".join(t for t in texts if t).encode("utf-8", "surrogatepass"), np.uint8)
            code = letters[data]
            if len(code) > 2:
                a, b, c = code[:-2], code[1:-1], code[2:]
                total += np.bincount((a * 729 + b * 27 + c)[(a > 0) & (b > 0) & (c > 0)], minlength=KEY)
            for text, path in zip(texts, batch.column("path").slice(part.start, part.stop - part.start).to_pylist(), strict=True) if labels else ():
                for _, body, before, after in candidates(text):
                    if (label := weak_label(body, before)) is not None:
                        found.add((body, before, after, path or "", label))
        if found:
            yield rows(len(found), **dict(zip(names[2:], zip(*sorted(found), strict=True), strict=True)))
    used = np.nonzero(total)[0]
    yield rows(len(used), triple=used, n=total[used])


def _texts(docs: DataFrame, *names: str) -> DataFrame:
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(*names, "text", path.alias("path"))


def _usual(evidence: DataFrame) -> np.ndarray:
    """Which of the 26^3 letter triples are usual."""
    count = np.zeros(KEY)
    for r in evidence.where("triple IS NOT NULL").groupBy("triple").agg(F.sum("n").alias("n")).collect():  # 17,576 at most
        count[r.triple] = r.n
    order = np.argsort(-count, kind="stable")
    reach = np.cumsum(count[order])
    usual = np.zeros(KEY, bool)
    if reach[-1]:
        usual[order[: int(np.searchsorted(reach, 0.99 * reach[-1])) + 1]] = True
    return usual & (count > 0)


FINDING = ["candidate", "before", "after", "path"]


def train(findings: list[tuple[str, str | None, str | None, str | None, int]], usual: np.ndarray) -> Forest:
    """Secrets that aren't hexadecimal are learned without their surroundings, too."""
    rows = sorted((c, b or "", a or "", p or "", y) for c, b, a, p, y in findings)
    rows += [(c, "", "", p, y) for c, _, _, p, y in rows if y and not HEX.match(c) and len(c) >= LEAST]
    forest = Forest()
    return forest.fit(describe([r[:4] for r in rows], usual), np.array([r[4] for r in rows], np.float64)) if rows else forest


def _scan(texts: list[str | None], paths: list[str | None], usual: np.ndarray, forest: Forest, least: float) -> list[list[tuple[int, str, float]]]:
    found = [candidates(t) for t in texts]
    flat = [(*c[1:], p) for f, p in zip(found, paths, strict=True) for c in f]
    p = forest.predict(describe(flat, usual)) if flat else np.empty(0)
    out, at = [], 0
    for f in found:
        out.append([(c[0], c[1], float(q)) for c, q in zip(f, p[at : at + len(f)], strict=True) if q >= least])
        at += len(f)
    return out


@tidy
def _findings(batches: Iterator[pa.RecordBatch], usual: np.ndarray, forest: Forest, least: float) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        rows = []
        for part in by_size(batch.column("text")):
            doc, text, path = (batch.column(c).slice(part.start, part.stop - part.start).to_pylist() for c in ("doc_id", "text", "path"))
            for d, found in zip(doc, _scan(text, path, usual, forest, least), strict=True):
                rows.extend((d, at, len(body), p, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()) for at, body, p in found)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "probability", "secret_sha256"])


def model_of(docs: DataFrame, findings: DataFrame | None = None, sample: int = 2000) -> tuple[np.ndarray, Forest]:
    """Usual triples and forest, from one scan of docs; ``findings``: candidate, before, after, label and, if known, path."""
    labels = findings is None
    evidence = written(_texts(docs).mapInArrow(lambda b: _evidence(b, labels), "triple long, n long, candidate string, before string, after string, path string, label int"), "evidence")
    if findings is not None:
        path = F.col("path") if "path" in findings.columns else F.lit("")
        return _usual(evidence), train([tuple(r) for r in findings.select(*FINDING[:3], path, "label").collect()], _usual(evidence))
    rows = made_findings()
    for label in (0, 1):
        some = evidence.where(F.col("label") == label).select(*FINDING, "label").distinct()
        rows += [tuple(r) for r in some.orderBy(F.xxhash64(*FINDING), *FINDING).limit(sample).collect()]
    usual = _usual(evidence)
    return usual, train(rows, usual)


def secrets(docs: DataFrame, usual: np.ndarray, forest: Forest, least: float = 0.5) -> DataFrame:
    """doc_id, start, length (characters), probability, secret_sha256 of each secret found."""
    rows = _texts(docs, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _findings(b, usual, forest, least), f"doc_id {kind}, start long, length long, probability double, secret_sha256 string")


def redacted(docs: DataFrame, usual: np.ndarray, forest: Forest, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in ``text`` replaced by a mark; every row and column stays."""

    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        texts, out = [None if t is None else t for t in texts], []
        for text, found in zip(texts, _scan(texts, list(paths), usual, forest, least), strict=True):
            for at, body, _ in reversed(found):
                text = text[:at] + mark + text[at + len(body) :]
            out.append(text)
        return pd.Series(out, dtype=object)

    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    return docs.withColumn("text", F.pandas_udf(clean, "string")("text", path))


def op10_secret_scan(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets(docs, *model_of(docs))
