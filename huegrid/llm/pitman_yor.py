"""LM scoring: a hierarchical Pitman-Yor model of words, with seatings sampled by Gibbs.

Words are served in one restaurant for each context; a context is the class of the word before, one of ``CONTEXTS``
classes by hash, so restaurants are shared by the words of a class and their number is fixed. All restaurants share one
parent, whose customers are their tables, and the parent's base is uniform over the known words and one unknown word.
The chance of word w after context g is

    (a[g,w] + (theta + d T[g]) P[w]) / (theta + C[g]),   P[w] = (b[w] + (theta0 + d0 T0) / (V + 1)) / (theta0 + C0)

with a = c - d t (customers and tables of the dish), b the same in the parent, and totals C and T. It sums to one over all
words and the unknown one. The chance of a word is the average of these chances over the Gibbs sweeps after ``burn_in``, each
with the seating and the totals of its own sweep.

A step of Gibbs sampling takes all customers of a dish out of a restaurant and seats them again one after the other, given
all others: the k-th opens a table with odds (theta + d T') P[w] : k - 1 - d t, T' without the dish's own tables.

How it runs: each task counts the (word, context) pairs of its rows and sends one packed row to every slot of the word
hash; a slot seats all customers of its words (a word's dishes in all restaurants and in the parent are in one slot). Each
sweep is a Spark job of its own: slots seat by the totals of all restaurants and of the parent as the sweep before left them,
added up over all slots, so nothing is estimated from a share of the words. Draws come from the hash of a dish, the sweep and the
step, so seatings and scores are the same for any number of slots and tasks. After the last sweep the tasks ask again, and the
slots answer with the numbers for their pairs, in the task's own order. Seatings and answers are written to the shared folder,
and the documents meet the answers of their task. So every count covers all training documents. A word costs a slot at most
CONTEXTS pairs for each task that asks, so the slot of a very frequent word grows with the number of tasks. Nothing but the
totals comes to the driver. Customers are seated one by one, and where a dish has seated many, k // ``GRAIN`` at a time: within
so small a step the odds change by less than one part in ``GRAIN``.

Defined results: null and empty texts have their end alone; a document with a null id is learned from and not held out;
repeated rows count and score as often as they stand; extra columns are ignored; an empty table gives no rows, and with
no training documents every probability is the unknown word's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import Vocabulary, doc_bucket, mix, slices, table, tidy, written

CONTEXTS, GRAIN, TOTALS = 1 << 16, 64, 1 << 13
END = b"\n"  # no word holds a line end
#: A slot's words with their training pairs (sweep -1), and what one sweep seated; part < 0: a piece of the slot's totals.
SEATED = "slot int, sweep int, part long, words binary, sizes binary, contexts binary, counts binary, t binary, top binary, totals array<double>"


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.T).tobytes(), 1)  # the sweeps of a pair side by side, as they are much alike


def _unpacked(data: list[bytes], kind: type, rows: int = 1) -> np.ndarray:
    """One array after the other, each of ``rows`` rows that were packed side by side."""
    import zstandard

    return np.ascontiguousarray(np.concatenate([np.frombuffer(zstandard.decompress(x), kind).reshape(-1, rows) for x in data]).T)


class Pairs:
    """The words of some texts and their (word, context) pairs, in an order that the order of the texts doesn't touch."""

    def __init__(self, texts: list[str | None], slots: int):
        vocabulary = Vocabulary(1 << 62)
        end = vocabulary.ids[END]
        ids, ends = vocabulary.encode(texts)
        hashes = vocabulary.hashed()
        slot = ((hashes >> np.uint64(12)) % np.uint64(slots)).astype(np.int64)
        order = np.lexsort((hashes, slot))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        context = (hashes % np.uint64(CONTEXTS)).astype(np.uint16)
        n = np.diff(ends) + 1
        self.starts = np.concatenate([[0], np.cumsum(n)])
        words = np.full(self.starts[-1], end, np.uint32)
        words[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        before = np.empty(len(words), np.uint16)
        before[1:] = context[words[:-1]]
        before[self.starts[:-1]] = context[end]
        self.hashes, self.slot = hashes[order], slot[order]
        self.word = rank[words].astype(np.uint32)
        key = self.word.astype(np.uint64) * np.uint64(CONTEXTS)
        key += before.astype(np.uint64)
        if len(order) * CONTEXTS < 1 << 32:
            key = key.astype(np.uint32)
        self.pair, place = np.unique(key, return_inverse=True)
        self.of_token = place.astype(np.uint32)
        self.pair_word = (self.pair // CONTEXTS).astype(np.int64)
        self.context = (self.pair % CONTEXTS).astype(np.int64)


@tidy
def _requests(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    parts: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for part, text, learn in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "learn")), strict=True):
            texts, learned = parts.setdefault(part, ([], []))
            texts.append(text)
            learned.append(learn)
    for part in sorted(parts):
        yield from _request(part, *parts.pop(part), slots)


def _request(part: int, texts: list[str | None], learn: list[bool], slots: int) -> Iterator[pa.RecordBatch]:
    pairs = Pairs(texts, slots)
    weight = np.repeat(np.array(learn, np.float32), np.diff(pairs.starts))
    count = np.bincount(pairs.of_token, weight, len(pairs.pair)).astype(np.uint32)
    word_at = np.searchsorted(pairs.slot, np.arange(slots + 1))
    pair_at = np.searchsorted(pairs.pair_word, word_at)
    size = np.bincount(pairs.pair_word, minlength=len(pairs.hashes)).astype(np.uint32)  # 1..CONTEXTS
    context = pairs.context.astype(np.uint16)
    for s in range(slots):
        w, p = slice(word_at[s], word_at[s + 1]), slice(pair_at[s], pair_at[s + 1])
        if w.stop > w.start:
            data = [pairs.hashes[w].tobytes(), size[w].tobytes(), context[p].tobytes(), count[p].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["slot", "part", "words", "sizes", "contexts", "counts"])


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of dishes (customers sorted down) when the k-th customer opens one with odds weight : k - 1 - discount * tables."""
    tables = (customers > 0).astype(np.float64)
    k, most = 2, int(customers[0]) if len(customers) else 0
    while k <= most:
        width = max(1, k // GRAIN)
        n = int(np.searchsorted(-customers, -k, "right"))  # those with at least k customers
        seated = k - 1 + (np.minimum(customers[:n], k + width - 1) - k) / 2
        chance = weight[:n] / (weight[:n] + np.maximum(seated - discount * tables[:n], 1e-9))
        if width == 1:
            tables[:n] += random.random(n) < chance
        else:
            tables[:n] += random.binomial(np.minimum(customers[:n], k + width - 1).astype(np.int64) - k + 1, chance)
        k += width
    return tables


def _merged(rows: pd.DataFrame) -> tuple:
    """Words of a slot; words and their numbers of pairs by task; pairs as word * CONTEXTS + context; the places of the tasks' words
    and pairs in the slot's; training counts of pairs."""
    hashes = [np.frombuffer(x, np.uint64) for x in rows.words]
    sizes = [np.frombuffer(x, np.uint32) for x in rows.sizes]
    words, index = np.unique(np.concatenate(hashes), return_inverse=True)
    context = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.contexts]).astype(np.int64)
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.counts])
    keys, pair = np.unique(np.repeat(index, np.concatenate(sizes)) * CONTEXTS + context, return_inverse=True)
    return words, hashes, sizes, keys, (index, pair), np.bincount(pair, count, len(keys))


def _pairs(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Words of a slot and word, context and count of its pairs, from the row that ``Model.opened`` made."""
    row = rows[rows.sweep == -1]
    words, sizes, contexts, counts = (_unpacked(list(row[c]), kind)[0] for c, kind in (("words", np.uint64), ("sizes", np.uint32), ("contexts", np.uint16), ("counts", np.uint32)))
    return words, np.repeat(np.arange(len(words)), sizes), contexts.astype(np.int64), counts


def _seated(*rows: dict) -> pd.DataFrame:
    """Rows with all columns of SEATED."""
    names = [c.split()[0] for c in SEATED.split(", ")]
    made = pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)
    return made.astype({"slot": np.int32, "sweep": np.int32, "part": np.int64})


class Draws:
    """Random numbers by the key of a dish and the step, with the names of numpy's generators."""

    def __init__(self, keys: np.ndarray, seed: int, sweep: int):
        self.keys, self.step = mix(keys ^ mix(np.array([seed * 1000 + sweep], np.uint64))), 0

    def _uniform(self, keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
        bits = mix(keys + mix(np.uint64(self.step << 32) | turn.astype(np.uint64)))
        return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def random(self, n: int) -> np.ndarray:
        self.step += 1
        return self._uniform(self.keys[:n], np.zeros(1))

    def binomial(self, n: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Successes of n trials, by the numbers of trials up to each success: some for all dishes, then twice as many where those don't reach n."""
        self.step += 1
        found, at, log, turn = np.zeros(len(n), np.int64), np.zeros(len(n)), np.log1p(-chance), 0
        busy, width = np.arange(len(n)), int(np.mean(n * chance)) + 2
        while len(busy):
            width = max(1, min(width, (1 << 18) // len(busy)))
            u = self._uniform(self.keys[busy, None], np.arange(turn, turn + width))
            reached = at[busy, None] + np.cumsum(np.floor(np.log(u) / log[busy, None]) + 1, axis=1)
            inside = reached <= n[busy, None]
            found[busy] += inside.sum(1)
            at[busy] = reached[:, -1]
            busy, turn, width = busy[inside[:, -1]], turn + width, 2 * width
        return found


class Model:
    def __init__(self, discount: float = 0.8, strength: float = 1.0, parent_discount: float = 0.75, parent_strength: float = 1.0, sweeps: int = 6, burn_in: int = 3, seed: int = 17):
        self.d, self.theta, self.d0, self.theta0 = discount, strength, parent_discount, parent_strength
        self.sweeps, self.burn_in, self.seed = sweeps, burn_in, seed

    def sweep(self, k: int, hashes: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray, t: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each pair and of each word in the parent after sweep k, from t and the totals before it (tables of each
        restaurant, of the parent, and known words)."""
        tables, top, known = totals[:CONTEXTS], totals[CONTEXTS], totals[CONTEXTS + 1]
        guests = np.bincount(word, t, len(hashes))
        order = np.argsort(-guests, kind="stable")
        base, above = (self.theta0 + self.d0 * top) / (known + 1), np.empty(len(hashes))
        above[order] = seat(guests[order], np.full(len(hashes), base), self.d0, Draws(hashes[order], self.seed, 2 * k))
        parent = (guests - self.d0 * above + base) / (self.theta0 + tables.sum())
        order = np.argsort(-count.astype(np.int64), kind="stable")
        w, g, seated = word[order], context[order], np.empty(len(word))
        keys = mix(hashes[w] ^ mix(g.astype(np.uint64) + np.uint64(1)))
        weight = (self.theta + self.d * np.maximum(tables[g] - t[order], 0)) * parent[w]
        seated[order] = seat(count[order].astype(np.int64), weight, self.d, Draws(keys, self.seed, 2 * k + 1))
        return seated, np.minimum(above, np.bincount(word, seated, len(hashes)))

    def _totals(self, slot: int, context: np.ndarray, t: np.ndarray, top: np.ndarray) -> list[dict]:
        all_totals = np.r_[np.bincount(context, t, CONTEXTS), top.sum(), len(top)]
        return [{"slot": slot, "sweep": -1, "part": -1 - k, "totals": all_totals[at].tolist()} for k, at in enumerate(slices(len(all_totals), TOTALS))]

    def opened(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The slot's words and pairs that training documents have, one table for each pair and word."""
        words, _, _, keys, _, total = _merged(rows)
        busy = total > 0
        known, word = np.unique(keys[busy] // CONTEXTS, return_inverse=True)
        context, slot = keys[busy] % CONTEXTS, rows.slot.iloc[0]
        sizes = np.bincount(word, minlength=len(known)).astype(np.uint32)
        data = {"words": words[known], "sizes": sizes, "contexts": context.astype(np.uint16), "counts": total[busy].astype(np.uint32)}
        row = {"slot": slot, "sweep": -1, "part": 0} | {name: _packed(x) for name, x in data.items()}
        return _seated(row, *self._totals(slot, context, np.ones(len(word)), np.ones(len(known))))

    def seated(self, rows: pd.DataFrame, k: int, totals: np.ndarray) -> pd.DataFrame:
        """One sweep over a slot, from its words and what the sweep before seated."""
        hashes, word, context, count = _pairs(rows)
        before = rows[rows.sweep == k - 1]
        t = np.ones(len(word)) if k == 0 else _unpacked(list(before.t), np.uint32)[0].astype(np.float64)
        t, top = self.sweep(k, hashes, word, context, count, t, totals)
        slot = rows.slot.iloc[0]
        row = {"slot": slot, "sweep": k, "part": 0, "t": _packed(t.astype(np.uint32)), "top": _packed(top.astype(np.uint32))}
        return _seated(row, *self._totals(slot, context, t, top))

    def alone(self, rows: pd.DataFrame) -> pd.DataFrame:
        """All sweeps over one slot, as if there were no other."""
        out = [self.opened(rows)]
        for k in range(self.sweeps):
            ends = out[-1][out[-1].part < 0].sort_values("part", ascending=False)
            totals = np.concatenate(list(ends.totals))
            out.append(self.seated(pd.concat([out[0], *out[1:][-1:]])[lambda x: x.part == 0], k, totals))
        return pd.concat([x[x.part == 0] for x in out])

    def kept(self, rows: pd.DataFrame, words: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        """For each sweep that is kept: a and t of each pair asked for, b and tables in the parent of each word."""
        hashes, word, context, count = _pairs(rows)
        at_word = np.searchsorted(words, hashes)
        at_pair = np.searchsorted(keys, at_word[word] * CONTEXTS + context)
        n = self.sweeps - self.burn_in
        s = {"a": np.zeros((n, len(keys))), "t": np.zeros((n, len(keys))), "b": np.zeros((n, len(words))), "top": np.zeros((n, len(words)))}
        for k in range(n):
            row = rows[rows.sweep == self.burn_in + k]
            t, top = (_unpacked(list(row[c]), np.uint32)[0].astype(np.float64) for c in ("t", "top"))
            s["t"][k, at_pair], s["a"][k, at_pair] = t, count - self.d * t
            s["top"][k, at_word], s["b"][k, at_word] = top, np.bincount(word, t, len(hashes)) - self.d0 * top
        return s

    def answer(self, rows: pd.DataFrame, slots: int, seated: pd.DataFrame | None = None) -> pd.DataFrame:
        """One row for each task that asked, and the slot's totals in rows of TOTALS numbers (part -1, -2, ...).

        ``seated`` has the slot's words and the sweeps that are kept; without it the slot seats by its own totals."""
        rows = rows.sort_values("part")
        words, hashes, sizes, keys, (index, pair), total = _merged(rows)
        word, context = keys // CONTEXTS, keys % CONTEXTS
        s = self.kept(self.alone(rows) if seated is None else seated, words, keys)
        customers = np.bincount(word, total, len(words))
        out, w, p = [], 0, 0
        for part, h, size in zip(rows.part, hashes, sizes, strict=True):
            some, pairs = index[w : w + len(h)], pair[p : p + int(size.sum())]
            out.append((part, _packed(s["a"][:, pairs].astype(np.float32)), _packed(customers[some].astype(np.float64)), _packed(s["b"][:, some].astype(np.float32)), None))
            w, p = w + len(h), p + int(size.sum())
        totals = [np.bincount(context, total, CONTEXTS), [customers.sum(), (customers > 0).sum()]]
        for t, top in zip(s["t"], s["top"], strict=True):
            totals += [np.bincount(context, t, CONTEXTS), [t.sum(), top.sum()]]
        totals = np.concatenate(totals)
        out.extend((-1 - k, None, None, None, totals[at].tolist()) for k, at in enumerate(slices(len(totals), TOTALS)))
        made = pd.DataFrame(out, columns=["part", "a", "customers", "b", "totals"])
        made.insert(0, "slot", np.full(len(made), rows.slot.iloc[0], np.int32))
        return made.astype({"part": np.int64})

    def chances(self, answers: pd.DataFrame, totals: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The average over the sweeps of the chance of each pair's word after its context."""
        sweeps = self.sweeps - self.burn_in
        a, b = (_unpacked(answers[c], np.float32, sweeps) for c in ("a", "b"))
        if a.shape[1] != len(word):
            raise RuntimeError("the documents of a task changed between two reads; write them to a table first")
        of_context, v, rest = totals[:CONTEXTS], totals[CONTEXTS + 1], totals[CONTEXTS + 2 :].reshape(sweeps, CONTEXTS + 2)
        total = np.zeros(len(word))
        for k in range(sweeps):
            tables, (guests, top) = rest[k, :CONTEXTS], rest[k, CONTEXTS:]
            parent = (b[k] + (self.theta0 + self.d0 * top) / (v + 1)) / (self.theta0 + guests)
            total += (a[k] + (self.theta + self.d * tables[context]) * parent[word]) / (self.theta + of_context[context])
        return total / sweeps

    def scored(self, docs: pd.DataFrame, answers: pd.DataFrame, totals: np.ndarray, slots: int) -> pd.DataFrame:
        pairs = Pairs(list(docs.text), slots)
        answers = answers.sort_values("slot")
        customers = _unpacked(answers.customers, np.float64)[0]
        n, v = totals[CONTEXTS : CONTEXTS + 2]
        chance = np.log10(self.chances(answers, totals, pairs.pair_word, pairs.context))
        base = np.log10((customers + 0.1) / (n + 0.1 * (v + 1)))
        starts = pairs.starts[:-1]
        return pd.DataFrame(
            {
                "doc_id": docs.doc_id,
                "held_out": docs.held_out,
                "n_tokens": np.diff(pairs.starts),
                "n_known": np.add.reduceat((customers > 0)[pairs.word].astype(np.int64), starts),
                "train_tokens": np.int64(n),
                "base_score": np.add.reduceat(base[pairs.word], starts),
                "score": np.add.reduceat(chance[pairs.of_token], starts),
            }
        )


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": rows.part[:1], "totals": [np.sum(np.sort(np.stack(rows.totals), axis=0), axis=0).tolist()]})


def _sums(rows: DataFrame, n: int) -> np.ndarray:
    """The totals of all slots: n numbers, in pieces of TOTALS; CONTEXTS + 2, and at the end as many for each sweep that is kept."""
    totals = np.zeros(n)
    for r in rows.where("part < 0").select("part", "totals").groupBy("part").applyInPandas(_summed, "part long, totals array<double>").collect():
        totals[TOTALS * (-1 - r.part) :][: len(r.totals)] = r.totals
    return totals


def _sweep(model: Model, k: int, totals: np.ndarray):
    return lambda rows: model.seated(rows, k, totals)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which the shuffles that it took are deleted."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(df.select("*"), name)
    finally:
        conf.set(key, before)


def score(docs: DataFrame, model: Model | None = None, folds: int = 10, splits: int = 4, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (log10 of the text's probability).

    Documents with crc32(doc_id as text) mod ``folds`` equal to 0 are not learned from. ``stable`` says that docs is a scan
    whose tasks read the same rows each time; other inputs are written to the shared folder first. The rows of a task are
    counted and scored in ``splits`` parts, by a hash of their id, which bounds the memory of a Python worker."""
    model = model or Model()
    held = F.coalesce(doc_bucket(folds) == 0, F.lit(False))
    rows = docs.select("doc_id", "text")
    rows = rows if stable else written(rows, "documents")
    slots = max(12, 2 * rows.rdd.getNumPartitions())
    part = F.spark_partition_id().cast("long") * splits + F.pmod(F.xxhash64("doc_id"), F.lit(splits))
    rows = rows.select("doc_id", "text", held.alias("held_out"), part.alias("part"))
    asked = rows.select("text", "part", (~F.col("held_out")).alias("learn")).mapInArrow(lambda b: _requests(b, slots), "slot int, part long, words binary, sizes binary, contexts binary, counts binary")
    first = _stored(asked.groupBy("slot").applyInPandas(lambda x: model.opened(x), SEATED), "slots")
    seated = [first]
    for k in range(model.sweeps):
        known = reduce(DataFrame.union, [x.where("part = 0") for x in (first, *seated[1:][-1:])])
        seated.append(_stored(known.groupBy("slot").applyInPandas(_sweep(model, k, _sums(seated[-1], CONTEXTS + 2)), SEATED), "sweep"))
    known = reduce(DataFrame.union, [x.where("part = 0") for x in (first, *seated[1 + model.burn_in :])])

    def answer(r: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return model.answer(r, slots, x)

    answers = asked.groupBy("slot").cogroup(known.groupBy("slot")).applyInPandas(answer, "slot int, part long, a binary, customers binary, b binary, totals array<double>")
    answers = _stored(answers, "answers")
    totals = _sums(answers, (CONTEXTS + 2) * (1 + model.sweeps - model.burn_in))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked_by = answers.where("part >= 0").select("part", "slot", "a", "customers", "b")

    def scored(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return model.scored(d, a, totals, slots)

    return rows.groupBy("part").cogroup(asked_by.groupBy("part")).applyInPandas(scored, schema)


def op3_lm_scoring(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), stable=True)
