"""Language ID recomputed plainly: hashed n-grams, weights by per-coordinate steps, temperature by its log loss."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidebook.llm import language_id

WORDS = {
    "de": "der die das und nicht ich über für straße mädchen wir haben".split(),
    "en": "the and not with have this that which water people from there".split(),
    "xx": "日本 語文 中国 漢字 世界 人間".split(),
}
FIT, CALIBRATE = 6, 3


def bucket(gram):
    h = 0
    for i, c in enumerate(gram):
        h = (h * 0x9FB21C651E98DF25 + ord(c) + i + 1) % 2**64
    return (((h ^ (h >> 29)) * 0xC2B2AE3D27D4EB4F) % 2**64) >> 49


def plain_counts(text):
    shown = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    return Counter(bucket(shown[i : i + n]) for n in (1, 2, 3) for i in range(len(shown) - n + 1))


def plain_softmax(scores):
    e = [math.exp(s - max(scores)) for s in scores]
    return [x / sum(e) for x in e]


class Plain:
    """The model by its definition. ``rows``: (place in the order of the id's hash, id, text, lang) that may be learned from."""

    def __init__(self, rows):
        found = Counter(b for _, _, text, _ in rows for b in plain_counts(text))
        self.idf = defaultdict(lambda: math.log(1 + len(rows)) + 1, {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in found.items()})
        chosen = []
        for lang in sorted({r[3] for r in rows}):
            of = sorted(r for r in rows if r[3] == lang)
            chosen += [(i, lang, text) for i, (_, _, text, _) in enumerate(of[: FIT + CALIBRATE], 1) if any(c.isalpha() for c in text)]
        self.languages = sorted({lang for _, lang, _ in chosen})
        bound = {c: min(FIT, max(1, max(i for i, lang, _ in chosen if lang == c) * 3 // 4)) for c in self.languages}
        self.z, self.q = defaultdict(float), defaultdict(float)
        for _ in range(3):
            for i, lang, text in sorted(chosen):
                if i <= bound[lang]:
                    self.step(self.features(text), lang)
        self.rest = [(self.scores(text), lang) for i, lang, text in sorted(chosen) if i > bound[lang]]

    def features(self, text):
        x = {b: (1 + math.log(n)) * self.idf[b] for b, n in plain_counts(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    def weight(self, key):
        z = self.z[key]
        return 0.0 if abs(z) <= 1e-3 else (math.copysign(1e-3, z) - z) / ((1.0 + math.sqrt(self.q[key])) / 0.5 + 1e-4)

    def linear(self, x):
        return [sum(v * self.weight((b, c)) for b, v in x.items()) + self.weight(("bias", c)) for c in self.languages]

    def scores(self, text):
        return self.linear(self.features(text))

    def step(self, x, lang):
        p = plain_softmax(self.linear(x))
        moves = []
        for c, share in zip(self.languages, p):
            for b, v in [*x.items(), ("bias", 1.0)]:
                g = v * (share - (c == lang))
                grown = (math.sqrt(self.q[b, c] + g * g) - math.sqrt(self.q[b, c])) / 0.5
                moves.append(((b, c), g - grown * self.weight((b, c)), g * g))
        for key, dz, dq in moves:
            self.z[key] += dz
            self.q[key] += dq

    def loss(self, temperature):
        smooth = 1 / (len(self.rest) + 2)
        total = 0.0
        for scores, lang in self.rest:
            p = plain_softmax([s / temperature for s in scores])
            total -= sum(math.log(x) * (1 - smooth if c == lang else smooth / (len(p) - 1)) for c, x in zip(self.languages, p))
        return total


def test_the_model_by_its_definition(spark):
    random.seed(10)
    docs = []
    for i in range(90):
        lang = random.choice(sorted(WORDS))
        other = random.choice(sorted(WORDS))
        words = random.choices(WORDS[lang], k=random.randint(2, 12)) + random.choices(WORDS[other], k=random.randint(0, 3))
        docs.append((i, random.choice([" ", ", ", "-1-"]).join(words).title(), lang))
    docs += [(200, "12 + 34", "en"), (201, None, "de"), (202, "no label", None), (None, "no id", "en"), (203, "", "de"), (5, docs[5][1], docs[5][2])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS spot", "2 AS seen")
    spots = {r.doc_id: r.spot for r in frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'sample'), 1 << 30) AS spot").collect()}
    usable = [(spots[i], i, t, lang) for i, t, lang in docs if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 3 != 1]
    plain, model = Plain(usable), language_id.learn(frame, FIT, CALIBRATE)
    assert model.languages == plain.languages == sorted(WORDS)
    for c, lang in enumerate(plain.languages):
        wanted = np.zeros(language_id.BUCKETS)
        for b in {b for b, of in list(plain.z) if of == lang and b != "bias"}:
            wanted[b] = plain.weight((b, lang))
        assert np.allclose(model.weights[:, c], wanted, rtol=1e-9, atol=1e-12)
        assert math.isclose(model.bias[c], plain.weight(("bias", lang)), rel_tol=1e-9, abs_tol=1e-12)
    assert plain.loss(model.temperature) <= min(plain.loss(math.exp(t / 50)) for t in range(-149, 149)) + 1e-9
    rows = language_id.predict(frame, model).collect()
    assert len(rows) == len(docs)
    for row, (i, text, _) in zip(rows, docs):  # one narrow pass keeps the order of a local table
        assert row.doc_id == i and row.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        if text is None or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            p = plain_softmax([s / model.temperature for s in plain.scores(text)])
            assert row.lang_pred == plain.languages[p.index(max(p))] and math.isclose(row.score, max(p), rel_tol=1e-7)


def test_collected_features_stay_in_arrow_memory(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of text" if i % 3 else "12 34", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    found = language_id.sampled_features(docs, 12)
    assert 0 < len(found) <= 12 and [order for _, order, *_ in found] == sorted(order for _, order, *_ in found)
    for _, _, seen, counts in found:
        assert seen.dtype == counts.dtype == np.int32 and len(seen) == len(counts) > 0 and seen.base is not None
        assert (np.diff(seen) > 0).all() and (counts > 0).all()
    assert language_id.sampled_features(docs.where("text = '12 34'"), 12) == []
