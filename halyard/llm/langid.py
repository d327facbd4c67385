"""Language ID by a linear-chain conditional random field over words.

Each word is a position of the chain; its emission scores are sums of learned weights of hashed features: the
whole word (lexicon), its byte n-grams of 2 to 4, and its affixes (n-grams that touch a word end carry a mark).
Transitions between the languages of neighbouring words are learned with them.  Forward-backward gives every
word its marginal distribution, so code-switched text is labelled word by word; a text's language is the
one with the largest summed marginal and its score is that sum divided by the number of words.

Long texts are cut into chains of ``CHAIN`` words, all of which are labelled.  Everything is vectorised over
chains; memory is bounded by the step size, whatever the length of a text.

Training is on a bounded sample: of each language at most ``per_lang`` distinct labelled texts, those of least hash, and of
each its first ``max_chars`` characters.  All languages are learned; the model takes 256 KB for each.  Prediction reads
the whole text and only the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halyard.llm.common import _ODD, Words, mix64, own, steps

CHAIN = 64
WEIGHT_BITS = 16
#: Words: letters a to z and bytes of non-ASCII characters, of lower-cased text.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
UNKNOWN = "und"


def _features(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of the picked words, word after word, and where each word's begin."""
    start, length = words.start[pick], (words.end - words.start)[pick]
    size = length + 2
    begin = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(begin, size)
    where = np.clip(np.repeat(start, size) + inside - 1, 0, max(0, len(words.data) - 1))
    edge = (inside == 0) | (inside == np.repeat(size, size) - 1)
    chars = np.where(edge, np.uint8(2), words.data[where] if len(words.data) else np.uint8(2)).astype(np.uint64)
    left = np.repeat(size, size) - inside
    owner = np.repeat(np.arange(len(pick)), size)
    found, owners = [words.hash[pick]], [np.arange(len(pick))]
    with np.errstate(over="ignore"):
        h = chars + np.uint64(1)
        for n in (2, 3, 4):
            h = h[:-1] * _ODD + chars[n - 1 :] + np.uint64(n)
            fits = left[: len(h)] >= n
            found.append(mix64(h[fits]))
            owners.append(owner[: len(h)][fits])
        index = (np.concatenate(found) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    counts = np.bincount(owners_all, minlength=len(pick))
    return index[order], np.cumsum(counts) - counts


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chain, place) of each word when texts with ``counts`` words are cut into chains."""
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    per = -(-counts // CHAIN)
    return np.repeat(np.cumsum(per) - per, counts) + inside // CHAIN, inside % CHAIN


def forward_backward(emit: np.ndarray, chain: np.ndarray, place: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of each word (and summed expected transitions) from log emissions of words in chains."""
    n, k = emit.shape
    m = int(chain[-1]) + 1 if n else 0
    size = np.bincount(chain, minlength=m)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    row = rank[chain]
    longest = int(size.max()) if m else 0
    alive = [int((size >= t + 1).sum()) for t in range(longest)]
    e = np.ones((longest, m, k))
    e[place, row] = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        a = alive[t]
        x = e[t, :a] * (first if t == 0 else alpha[t - 1, :a] @ move)
        alpha[t, :a] = x / x.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        a = alive[t + 1]
        x = (e[t + 1, :a] * beta[t + 1, :a]) @ move.T
        beta[t, :a] = x / x.sum(axis=1, keepdims=True)
    p = alpha[place, row] * beta[place, row]
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p
    total = np.zeros((k, k))
    for t in range(longest - 1):
        a = alive[t + 1]
        x = alpha[t, :a, :, None] * move[None] * (e[t + 1, :a] * beta[t + 1, :a])[:, None, :]
        total += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, total


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        _, pick, back = np.unique(words.hash, return_index=True, return_inverse=True)
        index, begin = _features(words, pick)
        if not len(pick):
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[index], begin, axis=0)[back].astype(np.float64)

    def marginals(self, words: Words) -> np.ndarray:
        """A row per word: the probability of each language, from the forward-backward pass over its chain."""
        chain, place = _chains(words.counts())
        return forward_backward(self.emissions(words), chain, place, self.trans, self.start)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each lower-cased text; -1 where it has no word."""
        words = Words(texts, LETTERS, lower=False)
        counts, k = words.counts(), len(self.langs)
        p = self.marginals(words)
        sums = np.stack([np.bincount(words.doc, weights=p[:, j], minlength=len(counts)) for j in range(k)], axis=1)
        best = sums.argmax(axis=1)
        score = sums[np.arange(len(counts)), best] / np.maximum(counts, 1)
        return np.where(counts > 0, best, -1), np.clip(np.where(counts > 0, score, 0.0), 0.0, 1.0)


def fit(texts: list[str], langs: list[str], epochs: int = 3, batch_chains: int = 400, rate: float = 0.3, seed: int = 5) -> Model:
    """Maximise the conditional likelihood of the words' labels (their text's language) by AdaGrad."""
    names = sorted(set(langs))
    k, size = len(names), 1 << WEIGHT_BITS
    model = Model(names, np.zeros((size, k), np.float32), np.zeros((k, k)), np.zeros(k))
    order = np.random.default_rng(seed).permutation(len(texts))
    words = Words(pa.array([texts[i].lower() for i in order], pa.string()), LETTERS, lower=False)
    if not len(words.hash):
        return model
    gold_doc = np.array([names.index(langs[i]) for i in order])
    _, pick, back = np.unique(words.hash, return_index=True, return_inverse=True)
    index, begin = _features(words, pick)
    ends = np.append(begin[1:], len(index))
    chain, place = _chains(words.counts())
    gold = gold_doc[words.doc]
    cuts = np.searchsorted(chain, np.arange(0, int(chain[-1]) + 1 + batch_chains, batch_chains))
    square_w, square_t, square_s = np.full((size, k), 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in rng.permutation(len(cuts) - 1):
            lo, hi = cuts[b], cuts[b + 1]
            if lo == hi:
                continue
            used, local = np.unique(back[lo:hi], return_inverse=True)
            count = (ends - begin)[used]
            at = np.repeat(begin[used] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            feats = index[at]
            emit = np.add.reduceat(model.weights[feats], np.cumsum(count) - count, axis=0)[local].astype(np.float64)
            c, y = chain[lo:hi] - chain[lo], gold[lo:hi]
            p, pairs = forward_backward(emit, c, place[lo:hi], model.trans, model.start, pairs=True)
            m = hi - lo
            diff = -p
            diff[np.arange(m), y] += 1
            same = c[1:] == c[:-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
            heads = place[lo:hi] == 0
            for j in range(k):
                g = np.bincount(feats, weights=np.repeat(np.bincount(local, weights=diff[:, j], minlength=len(used)), count), minlength=size).astype(np.float32) / np.float32(batch_chains)
                square_w[:, j] += g * g
                model.weights[:, j] += np.float32(rate) * g / np.sqrt(square_w[:, j])
            g = (seen - pairs) / batch_chains
            square_t += g * g
            model.trans += rate * g / np.sqrt(square_t)
            g = diff[heads].sum(axis=0) / batch_chains
            square_s += g * g
            model.start += rate * g / np.sqrt(square_s)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Hashes are drawn from this many numbers.
_SPACE = 1 << 62


def share_below(wanted: int, n: int) -> int:
    """The hash below which about ``wanted`` of ``n`` distinct values lie; all of them if there are no more."""
    return _SPACE if n <= wanted else _SPACE * wanted // n


def train(docs: DataFrame, per_lang: int = 150, max_chars: int = 20_000, **kw) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out (see the module's text).

    A repeated text counts once.  Nulls in text or lang, and texts without a letter, are left out.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(_SPACE)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << WEIGHT_BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    # thin by hash before ranking, so that ranking sees a few times per_lang texts whatever the size of the table
    least = docs.sparkSession.createDataFrame([(lang, share_below(2 * per_lang + 50, n)) for lang, n in sorted(counts.items())], "lang string, below long")
    few = rows.join(F.broadcast(least), "lang").where("h < below").groupBy("lang", "h").agg(F.min(F.substring("text", 1, max_chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = few.withColumn("r", rank).where(F.col("r") <= per_lang).orderBy("lang", "r").select("text", "lang").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], **kw)


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score; columns with these names are replaced.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing was learned.
    Repeated rows get equal results; no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in (lang, score)]
    lowered = own(df, "lowered")["lowered"]
    made = df.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.lower(text)).otherwise("").alias(lowered))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in steps(batch, lowered):
                if m.langs:
                    best, s = m.predict(part.column(lowered))
                else:
                    best, s = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                found = pa.array([m.langs[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found, pa.array(s, pa.float64())], names=[*keep, lang, score])

    return made.mapInArrow(run, schema)


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, probability) for each word of one text."""
    words = Words(pa.array([text.lower()], pa.string()), LETTERS, lower=False)
    p = model.marginals(words)
    best = p.argmax(axis=1)
    return [(words.data[a:b].tobytes().decode(), model.langs[i], float(q[i])) for a, b, i, q in zip(words.start, words.end, best, p, strict=True)]


def result(docs: DataFrame) -> DataFrame:
    model = train(docs)
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
