"""Language of every document and of every stretch of another language within it.

Hierarchical discrimination. Sentences are told apart by language family first, then one-versus-one linear support vector
machines separate the languages of the family. All machines work on hashed pieces of words, so the score of a sentence is
the mean of its words' scores: a word is scored once per worker, and the sentences of a batch are scored together, as the
product of their sparse matrix of words with the words' scores. Only families written in a sentence's script are
considered. The machines are fitted on a bounded sample of labelled documents, taken by hash: each half is first judged by
machines fitted on the other half, and sentences whose label these contradict are left out of the final fit. What the
judges get right at which margin on the half they have not seen gives the confidence of a margin.

Defined cases. Words with digits or underscores, settings, markup, JSON keys and
JSON values without any sentence mark are no words. A sentence has at least
MIN_WORDS words (Han characters count singly, MIN_HAN of them). Null, empty and blank texts and those without a sentence
have no segment. A sentence whose closest decision is under MIN_MARGIN (MIN_SHORT_MARGIN if short) takes the language of the sentence before
it, else of the one after, with confidence INHERITED. Labels count by their letters before any region; anything but a known code is missing. Whole
texts are read; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import BROKEN as _BROKEN
from loomgraph.llm.words import readable
from loomgraph.tables import spread_out

#: The languages and their families.
FAMILIES: dict[str, str] = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "pt": "romance", "it": "romance", "ru": "slavic", "zh": "sinitic"}
#: Documents of the sample per label, sentences of it per language, passes over them.
SAMPLE_DOCS = 600
SAMPLE_SENTENCES = 2500
EPOCHS = 4
BITS = 16
MIN_WORDS = 3
MIN_HAN = 4
#: Least margin of a decision, and that of a sentence of fewer than SHORT words (fragments of other texts are short).
MIN_MARGIN = 0.15
SHORT = 9
MIN_SHORT_MARGIN = 0.6
#: Confidence of a sentence that takes the language of another.
INHERITED = 0.5
#: Texts whose sentences are scored together, and steps of the calibration.
BATCH_TEXTS = 1024
STEPS = 20

_JSON_VALUE = re.compile(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_END = re.compile(r"[.!?;。！？；…]")
_JSON = re.compile(r'[{\[]\s*[{"]')
_SENTENCE = re.compile(r"[^.!?;。！？；…\n\r\x0b\x0c\u2028\u2029\x85|]+(?:[.!?;。！？；…]+|$|(?=[\n\r\x0b\x0c\u2028\u2029\x85|]))", re.M)
_SETTING = re.compile(r"\b[\w.]+\s*[=:]\s*[-+]?\d[\w.]*|\([^()]*\d[^()]*\)|<[^<>]*>|\[[^\[\]]*\]|[^\s\u3400-\u9fff\u3000-\u303f\uff00-\uffef]*[\d_][^\s\u3400-\u9fff\u3000-\u303f\uff00-\uffef]*")
#: A line end within a sentence.
_WRAPPED = re.compile(r"(?<=[^.!?;:。！？；\s])[ \t]*\r?\n[ \t]*(?=[a-zß-öø-ÿа-яё])")
_UNPLAIN = re.compile(r"[\d_<\[]")
_WORD = re.compile(r"[\u3400-\u9fff]|[^\W\d_\u3400-\u9fff]+(?:['’](?=[^\W\d_]))?")
_HAN = re.compile(r"[\u3400-\u9fff]")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text, in order."""
    if not text:
        return []
    if _JSON.search(text):
        text = _JSON_VALUE.sub(lambda m: f"\n{m[2]}\n" if _END.search(readable(m[2])) else "\n", text)
    out = []
    for piece in _SENTENCE.findall(readable(_WRAPPED.sub(" ", _BROKEN.sub("", text)))):
        ws = _WORD.findall(_SETTING.sub(" ", piece) if _UNPLAIN.search(piece) else piece)
        han = len(_HAN.findall("".join(ws))) if not piece.isascii() else 0
        if len(ws) - han >= MIN_WORDS or han >= MIN_HAN:
            out.append(ws)
    return out


def pieces(word: str) -> np.ndarray:
    """Hashed features of a word: itself, its 1- to 4-grams without accents, and its accented letters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    marked = f"<{plain}>"
    grams = {f"w{plain}", f"={word}"}
    for n in (1, 2, 3, 4):
        grams |= {marked[i : i + n] for i in range(len(marked) - n + 1)}
    grams |= {f"a{c}" for c in word if not c.isascii()}
    return np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) & ((1 << BITS) - 1) for g in grams), np.int64, len(grams))


SCRIPTS = ("latin", "cyrillic", "han")


def letter_script(word: str) -> int:
    """Place in SCRIPTS of the script of a word (latin for any other)."""
    c = word[0]
    return 2 if "\u3400" <= c <= "\u9fff" else 1 if "\u0400" <= c <= "\u04ff" else 0


def script(ws: Sequence[str]) -> str:
    """The script that more than half of the words are written in, else latin."""
    counts = [0, 0, 0]
    for w in ws:
        counts[letter_script(w)] += 1
    return SCRIPTS[2 if counts[2] * 2 > len(ws) else 1 if counts[1] * 2 > len(ws) else 0]


class Model:
    """One-versus-one machines between families, and between the languages of a family."""

    def __init__(self, labels: Sequence[str], families: Mapping[str, str] = FAMILIES):
        self.families = {c: families[c] for c in labels}
        groups: dict[str, list[str]] = defaultdict(list)
        for c in labels:
            groups[self.families[c]].append(c)
        self.groups = {f: sorted(g) for f, g in sorted(groups.items())}
        self.pairs = [("", a, b) for i, a in enumerate(self.groups) for b in list(self.groups)[i + 1 :]]
        self.pairs += [(f, a, b) for f, g in self.groups.items() for i, a in enumerate(g) for b in g[i + 1 :]]
        self.weights = np.zeros((max(1, len(self.pairs)), 1 << BITS), np.float32)
        self.scripts = dict.fromkeys(self.groups, "latin")
        #: Margins and the confidence at each, see calibrate.
        self.curve = np.array([0.0, 1.0]), np.array([0.5, 0.98])
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known, self.kinds = np.zeros((1024, len(self.weights)), np.float32), np.zeros(1024, np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "known", "kinds")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def fit(self, data: Sequence[tuple[list[str], str]], seed: int = 5) -> None:
        """Pegasos with averaging on (words, language)."""
        written: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for ws, c in data:
            written[self.families[c]][script(ws)] += 1
        self.scripts |= {f: max(n, key=n.get) for f, n in written.items()}
        data = [(ws, c) for ws, c in data if script(ws) == self.scripts[self.families[c]]]
        cache: dict[str, np.ndarray] = {}

        def features(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [cache[w] if w in cache else cache.setdefault(w, pieces(w)) for w in ws]
            at = np.concatenate(parts)
            return at, np.repeat([1 / (len(ws) * np.sqrt(len(p))) for p in parts], [len(p) for p in parts])

        ready = [(*features(ws), c) for ws, c in data]
        for m, (family, a, b) in enumerate(self.pairs):
            of = (lambda c: self.families[c]) if not family else (lambda c: c)
            own = [(at, v, 1.0 if of(c) == a else -1.0) for at, v, c in ready if of(c) in (a, b)]
            if not own:
                continue
            ups = sum(y > 0 for _, _, y in own)
            cost = {1.0: len(own) / (2 * max(1, ups)), -1.0: len(own) / (2 * max(1, len(own) - ups))}
            w, total, scale = np.zeros(1 << BITS), np.zeros(1 << BITS), 1.0
            rng, lam, t = np.random.default_rng(seed), 1e-4, 1
            for _ in range(EPOCHS):
                for i in rng.permutation(len(own)):
                    at, v, y = own[i]
                    t += 1
                    eta = 1 / (lam * (t + 1000))
                    margin = y * scale * np.dot(w[at], v)
                    scale *= 1 - eta * lam
                    if margin < 1:
                        np.add.at(w, at, eta * y * min(cost[y], 10.0) * v / scale)
                total += w * scale
            self.weights[m] = total / EPOCHS
        self._forget()

    def _place(self, word: str) -> int:
        """Row of a word in the table of scores."""
        at = self.place.get(word)
        if at is None:
            at = self.place[word] = len(self.place)
            if at == len(self.known):
                self.known, self.kinds = np.concatenate([self.known, np.zeros_like(self.known)]), np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            p = pieces(word)
            self.known[at], self.kinds[at] = self.weights[:, p].sum(1) / np.float32(np.sqrt(len(p))), letter_script(word)
        return at

    def predict_many(self, sentences: Sequence[Sequence[str]]) -> tuple[list[str], np.ndarray]:
        """(languages, margins): votes between the families and in the family; the margin is that of the closest decision taken."""
        if not sentences:
            return [], np.zeros(0)
        if len(self.place) > 300_000:
            self._forget()
        place = self._place
        words = np.fromiter((place(w) for ws in sentences for w in ws), np.int64)
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        starts = np.cumsum(sizes) - sizes
        scores = np.add.reduceat(self.known[words], starts, 0) / sizes[:, None].astype(np.float32)
        kinds = self.kinds[words]
        han, cyrillic = (np.add.reduceat((kinds == k).astype(np.int64), starts) * 2 > sizes for k in (2, 1))
        kind = np.where(han, 2, np.where(cyrillic, 1, 0))
        codes, margins = np.empty(len(sentences), object), np.empty(len(sentences))
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            names = [f for f in self.groups if self.scripts[f] == SCRIPTS[k]] or list(self.groups)
            family, sure = self._winners("", names, scores[at])
            for i, name in enumerate(names):
                own = family == i
                language, surer = self._winners(name, self.groups[name], scores[at[own]])
                codes[at[own]] = np.array(self.groups[name], object)[language]
                margins[at[own]] = np.minimum(sure[own], surer)
        return codes.tolist(), margins

    def predict(self, ws: Sequence[str]) -> tuple[str, float]:
        """(language, margin) of one sentence."""
        codes, margins = self.predict_many([ws])
        return codes[0], float(margins[0])

    def _winners(self, family: str, names: list[str], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the winner among the names, margin) of each row of scores."""
        votes, least = np.zeros((len(s), len(names))), np.full((len(s), len(names)), 9.0)
        for m, (f, a, b) in enumerate(self.pairs):
            if f == family and a in names and b in names:
                i, j, v = names.index(a), names.index(b), s[:, m].astype(np.float64)
                vote = 1 + np.minimum(np.abs(v), 1) / 100
                votes[:, i] += np.where(v > 0, vote, 0)
                votes[:, j] += np.where(v > 0, 0, vote)
                least[:, i], least[:, j] = np.minimum(least[:, i], v), np.minimum(least[:, j], -v)
        best = votes.argmax(1)
        return best, np.maximum(0.0, least[np.arange(len(s)), best])

    def calibrate(self, margins: np.ndarray, agree: np.ndarray) -> None:
        """Confidence by margin: the share of held-out sentences that agree with their label, never falling with the
        margin, relative to the share at the widest margins, since some labels are wrong at any."""
        order = np.argsort(margins, kind="stable")
        if len(order) < 2 * STEPS:
            return
        at, share = ([c.mean() for c in np.array_split(x[order].astype(float), STEPS)] for x in (margins, agree))
        blocks: list[list[float]] = []  # pool adjacent violators
        for y in share:
            blocks.append([y, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                y1, n1 = blocks.pop()
                y0, n0 = blocks.pop()
                blocks.append([(y0 * n0 + y1 * n1) / (n0 + n1), n0 + n1])
        rising = np.repeat([y for y, _ in blocks], [int(n) for _, n in blocks])
        self.curve = np.array(at), np.clip(rising / max(rising[-1], 1e-9), 0, 1)

    def confidence(self, margins: np.ndarray) -> np.ndarray:
        return np.interp(margins, *self.curve)


def label_code(label: Column) -> Column:
    """Known two-letter code of a label, whatever its case, blanks and region; null if it names none."""
    code = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " "))), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(code.isin(*FAMILIES), code)


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_sentences: int = SAMPLE_SENTENCES) -> Model:
    """A model from at most sample_docs labelled documents of each language."""
    labelled = documents.select("doc_id", label_code(F.col("lang")).alias("code")).where("code is not null")
    ranked = labelled.withColumn("_r", F.expr("row_number() over (partition by code order by xxhash64(doc_id), doc_id)")).where(F.col("_r") <= sample_docs)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ranked), "doc_id").select("code", "text").toArrow()  # sample_docs rows per known code
    by_hash = lambda t: (zlib.crc32(t[1].encode("utf-8", "replace")), t)
    return fitted(sorted(zip(texts["code"].to_pylist(), texts["text"].to_pylist()), key=by_hash), sample_sentences)


def fitted(texts: Sequence[tuple[str, str]], sample_sentences: int = SAMPLE_SENTENCES) -> Model:
    """A model from (language, text)."""
    halves: list[list] = [[], []]
    seen, per = set(), defaultdict(int)
    for code, text in texts:
        half = halves[zlib.crc32(text.encode("utf-8", "replace")) & 1]
        for ws in sentences(text):
            line = (code, " ".join(ws))
            if line not in seen and per[code] < sample_sentences:
                seen.add(line)
                per[code] += 1
                half.append((ws, code))
    kept, margins, agree = [], [], []
    for own, other in (halves, halves[::-1]):
        judge = Model(sorted({c for _, c in other}) or ["en"])
        judge.fit(other)
        codes, sure = judge.predict_many([ws for ws, _ in own])
        known = np.array([c in judge.families for _, c in own], bool)
        right = np.array([c == found for (_, c), found in zip(own, codes)], bool)
        kept += [line for line, k, r in zip(own, known, right) if r or not k]
        margins.append(sure[known])
        agree.append(right[known])
    data = kept if {c for _, c in kept} == set(per) else halves[0] + halves[1]
    model = Model(sorted(per) or ["en"])
    model.fit(data)
    model.calibrate(np.concatenate(margins), np.concatenate(agree))
    return model


Segment = tuple[int, str, float, int]


def segments_of(model: Model, texts: Sequence[str | None]) -> list[list[Segment]]:
    """Of each text (seg_no, language, confidence, sentences) of each maximal stretch of sentences in one language."""
    every = [sentences(t) for t in texts]
    codes, margins = model.predict_many([ws for own in every for ws in own])
    sure, margins = model.confidence(margins).tolist(), margins.tolist()
    out, at = [], 0
    for own in every:
        end = at + len(own)
        out.append(_stretches(own, codes[at:end], margins[at:end], sure[at:end]))
        at = end
    return out


def _stretches(own: Sequence[Sequence[str]], alone: Sequence[str], margins: Sequence[float], sure: Sequence[float]) -> list[Segment]:
    codes: list[str | None] = [c if m >= (MIN_SHORT_MARGIN if len(ws) < SHORT else MIN_MARGIN) else None for ws, c, m in zip(own, alone, margins)]
    for i, c in enumerate(codes):
        if c is None and i:
            codes[i] = codes[i - 1]
    for i in range(len(codes) - 2, -1, -1):
        codes[i] = codes[i] or codes[i + 1]
    out: list[list] = []
    for found, code, p in zip(alone, codes, sure):
        code = code or found
        p = p if code == found else INHERITED
        if out and out[-1][1] == code:
            out[-1][2] += p
            out[-1][3] += 1
        else:
            out.append([len(out) + 1, code, p, 1])
    return [(n, c, round(s / k, 4), k) for n, c, s, k in out]


def segments(model: Model, text: str | None) -> list[Segment]:
    """Those of one text."""
    return segments_of(model, [text])[0]


def label_documents(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, code (of the label, null if missing), seg_no, lang, confidence, sentences, and of the document segments and first_lang."""
    sent = documents.sparkSession.sparkContext.broadcast(model or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rows, (docs, labels, texts) = [], (c.to_pylist() for c in b.columns)
            for i in range(0, len(texts), BATCH_TEXTS):
                for d, code, found in zip(docs[i:], labels[i:], segments_of(sent.value, texts[i : i + BATCH_TEXTS])):
                    rows += [(d, code, *s, len(found), found[0][1]) for s in found]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "code", "seg_no", "lang", "confidence", "sentences", "segments", "first_lang"])

    texts = spread_out(documents.select(F.col("doc_id").cast("long"), label_code(F.col("lang")).alias("code"), "text"))
    return texts.mapInArrow(run, "doc_id long, code string, seg_no int, lang string, confidence double, sentences int, segments int, first_lang string")


def mislabelled(labelled: DataFrame) -> DataFrame:
    """The segments of the documents whose label is missing or wrong, or that mix languages."""
    return labelled.where("segments > 1 or code is null or code <> first_lang")
