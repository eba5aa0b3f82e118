"""Language of code-switched text: a linear-chain conditional random field labels words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, blocks, fresh, mix, text_buffer

BITS = 18
#: Longer lines are labelled in pieces of this many words, each with CONTEXT words of its line on either side.
CHAIN, CONTEXT = 256, 24
#: Numbers that one forward-backward pass holds for each label.
CELLS = 1 << 20


def _plain(data: np.ndarray) -> np.ndarray:
    """Bytes with the capital letters of Latin-1 in lower case."""
    out = data.copy()
    up = (out >= 65) & (out <= 90)
    out[up] += 32
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[wide] += 32
    return out


class Feats:
    """Features of the words of a block: hashed n-grams with word ends, affixes and the word itself,
    and the language whose lexicon has the word.

    lexicon: sorted word hashes and the label of each; the feature's ids follow the hashed ones.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray] | None = None):
        self.words = w = Words(offsets, data)
        w.data = plain = _plain(data)
        size = w.ends - w.starts
        self.bound = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(w.starts - self.bound[:-1], size) + np.arange(self.bound[-1])
        cur = plain[at].astype(np.uint32)
        before, after = np.empty_like(cur), np.empty_like(cur)
        before[1:], after[:-1] = cur[:-1], cur[1:]
        before[self.bound[:-1]], after[self.bound[1:] - 1] = 32, 32
        mask = np.uint32((1 << BITS) - 1)
        tri = (before | cur << np.uint32(8) | after << np.uint32(16)) * np.uint32(0x9E3779B1)
        self.tri = (tri >> np.uint32(32 - BITS)) & mask
        self.bi = (((cur | after << np.uint32(8)) + np.uint32(0x10000)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)) & mask
        top = U64(64 - BITS)
        self.hashes = w.hashes()
        if len(size):
            first, last = w.starts, w.ends - 1
            b = lambda p: plain[np.clip(p, 0, len(plain) - 1)].astype(U64)
            head = b(first) | b(np.minimum(first + 1, last)) << U64(8) | b(np.minimum(first + 2, last)) << U64(16)
            tail = b(last) | b(np.maximum(last - 1, first)) << U64(8) | b(np.maximum(last - 2, first)) << U64(16)
            self.affix = np.stack([(mix(head + U64(1 << 32)) >> top), (mix(tail + U64(2 << 32)) >> top), (mix(tail | b(np.maximum(last - 3, first)) << U64(24) | U64(3 << 32)) >> top), (mix(self.hashes) >> top), self._listed(lexicon)], 1).astype(np.int64)
        else:
            self.affix = np.zeros((0, 5), np.int64)
        letter = ((plain >= 97) & (plain <= 122)) | (plain >= 0xC3)
        count = np.concatenate([[0], np.cumsum(letter)])
        self.letters = count[w.ends] - count[w.starts]

    def _listed(self, lexicon) -> np.ndarray:
        """Weight row of the lexicon each word is in: one for each label, and one for none before them."""
        out = np.full(len(self.hashes), 1 << BITS, U64)
        if lexicon and len(lexicon[0]):
            at = np.minimum(np.searchsorted(lexicon[0], self.hashes), len(lexicon[0]) - 1)
            hit = lexicon[0][at] == self.hashes
            out[hit] += (1 + lexicon[1][at[hit]]).astype(U64)
        return out

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        n = len(self.words.starts)
        if not n:
            return np.zeros((0, weights.shape[1]))
        each = weights[self.tri] + weights[self.bi]
        out = np.add.reduceat(each, self.bound[:-1], axis=0)
        for k in range(self.affix.shape[1]):
            out += weights[self.affix[:, k]]
        return out.astype(float)


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False, core: tuple[np.ndarray, np.ndarray] | None = None):
    """Posterior of each word's label; with pairs also the expected transitions.

    Chains are words first[c] ... first[c] + size[c] - 1; chains of like length step together. Of a
    chain only the words core[0][c] ... core[1][c] - 1, counted from its first, are reported (all).
    """
    k = emit.shape[1]
    skip, stop = core if core else (np.zeros_like(size), size)
    post = np.zeros_like(emit)
    both = np.zeros((k, k))
    move = np.exp(trans - trans.max())
    begin = np.exp(start - start.max())
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        c = order[lo : lo + 4096]
        c = c[: max(1, CELLS // int(size[c[-1]]))]
        lo += len(c)
        f, s = first[c], size[c]
        steps = int(s.max()) if len(s) else 0
        at = np.minimum(f[None, :] + np.arange(steps)[:, None], len(emit) - 1)
        live = np.arange(steps)[:, None] < s[None, :]
        e = emit[at]
        e = np.exp(e - e.max(2, keepdims=True))
        fwd = np.empty_like(e)
        a = begin * e[0]
        fwd[0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            a = (fwd[t - 1] @ move) * e[t]
            a /= a.sum(1, keepdims=True)
            fwd[t] = a if live[t].all() else np.where(live[t][:, None], a, fwd[t - 1])
        bwd = np.ones((len(c), k))
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps:
                nxt = e[t + 1] * bwd
                if pairs:
                    joint = fwd[t][:, :, None] * move[None] * nxt[:, None, :]
                    joint /= joint.sum((1, 2), keepdims=True)
                    both += joint[live[t + 1]].sum(0)
                nb = nxt @ move.T
                nb /= nb.sum(1, keepdims=True)
                bwd = np.where(live[t + 1][:, None], nb, bwd)
            p = fwd[t] * bwd
            p /= p.sum(1, keepdims=True)
            tell = live[t] & (t >= skip[c]) & (t < stop[c])
            post[at[t][tell]] = p[tell]
    return post, both


@dataclass
class LanguageField:
    """Labels in order, emission weights of features, transition and first-word scores, and the lexicon."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def blank(cls, labels: list[str], lexicon=None) -> LanguageField:
        k = len(labels)
        return cls(labels, np.zeros(((1 << BITS) + k + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)

    def chains(self, feats: Feats, offsets: np.ndarray, data: np.ndarray):
        """Lines of documents as word ranges, longer ones in pieces with context: first word, size and core."""
        cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])) if len(offsets) > 1 else np.zeros(0, np.int64)
        first = np.unique(np.searchsorted(feats.words.starts, cuts))
        n = len(feats.words.starts)
        first = first[first < n]
        size = np.diff(np.append(first, n))
        parts = -(-size // CHAIN)
        line = np.repeat(np.arange(len(first)), parts)
        begin = first[line] + CHAIN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.diff(np.append(begin, n)) + begin
        left, right = np.maximum(begin - CONTEXT, first[line]), np.minimum(end + CONTEXT, (first + size)[line])
        return left, right - left, (begin - left, end - left)

    def label_words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[Feats, np.ndarray]:
        """Features of a block and the posterior of every word's language."""
        feats = Feats(offsets, data, self.lexicon)
        first, size, core = self.chains(feats, offsets, data)
        return feats, forward_backward(feats.emissions(self.weights), self.trans, self.start, first, size, core=core)[0]


def word_lists(segments: list[tuple[str, bytes]], labels: list[str], least: int = 5, share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words seen at least `least` times, `share` of them in one language, and its label."""
    hashes, owner = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for k, name in enumerate(labels):
        texts = [t for lang, t in segments if lang == name]
        feats = Feats(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.frombuffer(b"".join(texts), np.uint8))
        hashes.append(feats.hashes)
        owner.append(np.full(len(feats.hashes), k))
    kinds, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.zeros((len(kinds), len(labels)), np.int64)
    np.add.at(count, (inverse, np.concatenate(owner)), 1)
    total = count.sum(1)
    known = (total >= least) & (count.max(1, initial=0) >= share * total)
    return kinds[known], count[known].argmax(1) if len(labels) else np.zeros(0, np.int64)


def train_field(segments: list[tuple[str, bytes]], chains: int = 4000, epochs: int = 4, rate: float = 0.3, seed: int = 5) -> LanguageField:
    """A field from (language, text) segments, joined at random into chains that switch language.

    Chains of one to four segments teach emissions and transitions together, by AdaGrad on the
    likelihood's gradient from forward-backward.
    """
    labels = sorted({lang for lang, _ in segments})
    k = len(labels)
    model = LanguageField.blank(labels, word_lists(segments, labels))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    by = [[t for x, t in segments if x == lang] for lang in labels]
    grad2 = [np.full_like(model.weights, 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)]
    batch = 200
    for _ in range(epochs * chains // batch):
        texts, owner, sizes = [], [], []
        for _ in range(batch):
            some, prev = rng.integers(1, 5), None
            total = 0
            for _ in range(some):
                lang = prev if prev is not None and rng.random() < 0.3 else int(rng.integers(k))
                t = by[lang][int(rng.integers(len(by[lang])))]
                n = len(Words(np.array([0, len(t)]), np.frombuffer(t, np.uint8)).starts)
                texts.append(t)
                owner += [lang] * n
                total += n
                prev = lang
            sizes.append(total)
        data = np.frombuffer(b"".join(texts), np.uint8)
        feats = Feats(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), data, model.lexicon)
        y = np.array(owner)
        size = np.array(sizes)
        keep = size > 0
        first = (np.cumsum(size) - size)[keep]
        size = size[keep]
        post, pairs = forward_backward(feats.emissions(model.weights), model.trans, model.start, first, size, True)
        g = post
        g[np.arange(len(y)), y] -= 1
        seen = np.zeros((k, k))
        inner = np.ones(len(y), bool)
        inner[first] = False
        np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        word = np.repeat(np.arange(len(y)), np.diff(feats.bound))
        ids = np.concatenate([feats.tri.astype(np.int64), feats.bi.astype(np.int64), feats.affix.T.ravel()])
        of = np.concatenate([word, word, np.tile(np.arange(len(y)), feats.affix.shape[1])])
        used, inverse = np.unique(ids, return_inverse=True)
        gw = np.stack([np.bincount(inverse, g[of, j]) for j in range(k)], 1) / batch + 1e-4 * model.weights[used]
        grad2[0][used] += gw**2
        model.weights[used] -= rate * gw / np.sqrt(grad2[0][used])
        for value, step, j in ((model.trans, (pairs - seen) / batch, 1), (model.start, g[first].sum(0) / batch, 2)):
            grad2[j] += step**2
            value -= rate * step / np.sqrt(grad2[j])
    return model


def fit_language(docs: DataFrame, max_docs: int = 3000, per_doc: int = 6, words: int = 12, max_labels: int = 256) -> LanguageField:
    """A field learned from docs (doc_id, text, lang); null lang, text or doc_id is left out.

    It learns from about max_docs documents, as many of each language, those with the smallest hash of
    their id, and of each from at most per_doc segments of `words` words spread over its whole text,
    which bounds what reaches the driver. More than max_labels languages are an error, as the weights
    grow with their number.
    """

    def cut(batches):
        for batch in batches:
            out = []
            o, b = text_buffer(batch.column("text"))
            for i, j in blocks(o):
                w = Words(o[i : j + 1] - o[i], b[o[i] : o[j]])
                raw = w.data.tobytes()
                for p, q in zip(w.ptr.tolist(), w.ptr[1:].tolist(), strict=False):
                    spots = sorted({p + (q - p) * s // per_doc for s in range(per_doc)} if q > p else ())
                    out.append([raw[w.starts[at] : w.ends[min(at + words, q) - 1]] + b" " for at in spots])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "segments"])

    span = 1 << 40
    h = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    usable = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "text", h.alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    if not counts:
        return LanguageField.blank([])
    each = max_docs // len(counts) + 1
    # first what the hash of the id lets through, half again as many as are wanted, then exactly those
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, span if n <= 2 * each else int(span * 1.5 * each / n))])
    some = usable.where(F.col("h") < bound[F.col("lang")]).select("lang", "h", "text").mapInArrow(cut, "lang string, h long, segments array<binary>")
    order = Window.partitionBy("lang").orderBy("h", "segments")
    rows = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", F.explode("segments").alias("segment")).collect()
    return train_field(sorted((r["lang"], bytes(r["segment"])) for r in rows))


def predict_language(docs: DataFrame, model: LanguageField, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the language that most of a text is in and its share of the text's letters.

    Words are labelled by forward-backward over each line; a word counts by its letters. Lines over
    CHAIN words are labelled in pieces that see CONTEXT words of the line before and after them. `und` with
    score 0 if a text is null or has no letter, or nothing was learned. Ties go to the first label in
    order. Rows and other columns stay; columns of those two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def run(col: pa.Array) -> pa.Array:
        m = held.value
        lang, score = [], []
        o, b = text_buffer(col)
        for i, j in blocks(o):
            offsets, data = o[i : j + 1] - o[i], b[o[i] : o[j]]
            n = j - i
            share = np.zeros((n, len(m.labels)))
            if len(m.labels):
                feats, post = m.label_words(offsets, data)
                doc = feats.words.doc_of()
                share = np.stack([np.bincount(doc, feats.letters * post[:, k], minlength=n) for k in range(len(m.labels))], 1)
            total = share.sum(1)
            some = total > 0
            if len(m.labels):
                for d in np.flatnonzero(some):  # bytes above ASCII may belong to signs that are no letters
                    part = data[offsets[d] : offsets[d + 1]]
                    low = part | 32
                    if not ((low >= 97) & (low <= 122)).any():
                        some[d] = any(ch.isalpha() for ch in part.tobytes().decode("utf-8", "replace"))
                for d in np.flatnonzero(~some):  # letters written in bytes the weights leave out
                    if any(ch.isalpha() for ch in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")):
                        some[d], share[d], total[d] = True, 1.0, len(m.labels)
                best = share.argmax(1)
            for d in range(n):
                lang.append(m.labels[best[d]] if some[d] else "und")
                score.append(float(share[d, best[d]] / total[d]) if some[d] else 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    told = fresh("_lang", [*docs.columns, lang_col, score_col])
    out = docs.drop(lang_col, score_col).withColumn(told, run("text"))
    return out.withColumns({lang_col: F.col(f"{told}.lang"), score_col: F.col(f"{told}.score")}).drop(told)
