"""Problem 8: scores for abusive, hateful and sexually explicit language.

Lines of the cues are folded to a form that survives disguise and damage. Many lexicon and pattern voters vote on each line; a
generative label model estimates how accurate the voters are and how they are correlated from their agreement over all lines,
without labels; a linear classifier is trained on its posterior labels and scores every line of every document.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.functions.names import cleaned
from quillmap.llm.abuse_words import WORDS
from quillmap.operators.exact_take import random_key, uniform
from quillmap.session import cut, stored

#: Voters: name, and when the kinds of words found near each other make it fire. Words that condemn, or speak of animals, medicine or
#: machines, stop some of them.
RULES = {
    "scorn": lambda k: "off" in k,
    "insult to the face": lambda k: k >= {"noun", "you"} and "against" not in k,
    "insult with adjective": lambda k: k >= {"noun", "adj"} and "against" not in k,
    "insult of another": lambda k: "noun" in k and bool(k & {"look", "only"}) and "against" not in k,
    "mild insult": lambda k: k >= {"mild", "you", "adj"} and "against" not in k,
    "no more than": lambda k: k >= {"only", "you"} and bool(k & {"mild", "noun", "foul"}) and "against" not in k,
    "insulted body": lambda k: k >= {"adj", "body", "wish"} and "plain" not in k,
    "threat": lambda k: k >= {"harm", "you"} and bool(k & {"me", "body"}) and "plain" not in k,
    "weapon": lambda k: k >= {"weapon", "you"} and bool(k & {"me", "body"}) and "plain" not in k,
    "death wish": lambda k: k >= {"die", "you", "wish"} and "plain" not in k,
    "world without you": lambda k: k >= {"worse", "withyou"} or k >= {"better", "without"},
    "group degraded": lambda k: "group" in k and bool(k & {"vermin", "low", "foul"}) and "against" not in k,
    "group threatened": lambda k: "group" in k and bool(k & {"rid", "exterm"}) and not k & {"against", "plain"},
    "they degraded": lambda k: "foul" in k and bool(k & {"are", "sort"}) and not k & {"against", "plain"},
    "they threatened": lambda k: k >= {"exterm", "they"} and not k & {"against", "plain"},
    "degraded and threatened": lambda k: k >= {"exterm", "foul"} and not k & {"against", "plain"},
    "only good dead": lambda k: k >= {"onlygood", "die"},
    "arson": lambda k: k >= {"holy", "fire", "they"} and "against" not in k,
    "sexual word": lambda k: "sex" in k and "plain" not in k,
    "sexual scene": lambda k: len(k & {"bare", "part", "act", "pose", "plea"}) >= 2 and "plain" not in k,
}
#: Voters of the other side: they fire where these words are all that keeps one of the rules from firing.
AGAINST = {"condemns": "against", "plain sense": "plain"}
VOTERS = [*RULES, *AGAINST, "masked word"]
#: Lines that the linear classifier is fitted on at most, half of them lines without a vote.
FIT_LINES = 40_000

# ---- text -------------------------------------------------------------------------------------------------------------


def _byte(error: UnicodeEncodeError):
    text = error.object[error.start : error.end]
    if all(ord(c) < 256 for c in text):
        return bytes(ord(c) for c in text), error.end
    raise error


#: A letter whose second byte was lost: the most frequent letter with that first byte stands in.
LOST = {"Ñ\ufffd": "Ñ\x81", "Ð\ufffd": "Ð\x9d", "Ã\ufffd": "Ã\xad"}
BROKEN = re.compile(r"[ÂÃÐÑâ][^\x00-\x7f]|[РСГВв][^\x00-\x7fА-яЁё]")
WESTERN = re.compile(r"[À-ÿ]")
LETTER = re.compile(r"[^\W\d_]")


def unbroken(line: str) -> str:
    """A line that was read in another encoding, set right. Others come back as they are.

    UTF-8 read as a western or Cyrillic code page is undone up to twice, also where some bytes were lost; a Cyrillic code page
    read as a western one shows as words of accented letters only.
    """
    for _ in range(2):
        for codec in ("cp1252", "cp1251"):
            try:
                line = line.encode(codec, "quillmap_byte").decode("utf-8")
                break
            except UnicodeError:
                pass
        else:
            break
        if line.isascii():
            return line
    if "\ufffd" in line and BROKEN.search(line):
        for lost, letter in LOST.items():
            line = line.replace(lost, letter)
        try:
            line = line.replace("\ufffd", "?").encode("cp1252", "quillmap_byte").decode("utf-8", "ignore")
        except UnicodeError:
            pass
    west = len(WESTERN.findall(line))
    if west >= 4 and west > 0.6 * len(LETTER.findall(line)):
        try:
            line = line.encode("cp1252", "quillmap_byte").decode("cp1251")
        except UnicodeError:
            pass
    return line


import codecs  # noqa: E402

codecs.register_error("quillmap_byte", _byte)

#: Markup of cues, and marks without width.
TAGS = re.compile(r"</?(?:i|b|u|s|c|v|p|br|em|font|span|lang|ruby|rt)\b[^<>\n]{0,60}>|<[\d:.]+>|\{(?:\\|[A-Za-z]:)[^{}\n]{0,60}\}|[\u00ad\u200b-\u200f\u2060\ufeff]", re.I)
#: Cue numbers, times and headers; comments only where the text has the header of the format that knows them.
NOT_SPOKEN = re.compile(r"[\W\d_]*|\W*[\d:.,]+\s*-->\s*[\d:.,]+.*|WEBVTT.*|NOTE|STYLE")
#: A word some of whose letters are stars.
MASK = re.compile(r"(?<![\w*])\w[\w*]*\*[\w*]*(?![\w*])")


def _masked_words() -> dict[int, list[str]]:
    """Insulting and explicit words by length: what a masked word may stand for."""
    out: dict[int, list[str]] = {}
    for own in WORDS.values():
        for kind in ("noun", "sex", "foul", "mild", "part", "bare", "adj", "off"):
            for word in own.get(kind, "").replace(", ", " ").split():
                word = word.rstrip("*")
                if len(word) > 3:
                    out.setdefault(len(word), []).append(word)
    return out


MASKED = _masked_words()


def unmasked(line: str) -> tuple[str, bool]:
    """The line with masked words filled in, and whether there were any: a word of that length that agrees with the letters shown."""
    hit = False

    def fill(m: re.Match) -> str:
        nonlocal hit
        shown = m[0].lower()
        if sum(c != "*" for c in shown) * 4 < len(shown):
            return m[0]
        for word in MASKED.get(len(shown), []):
            if all(a in ("*", b) for a, b in zip(shown, word)):
                hit = True
                return word
        return m[0]

    return MASK.sub(fill, line), hit


def _folding() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in [*range(0x20, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2070), *range(0x3000, 0x3040), *range(0xFF00, 0xFFF0)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        table[code] = base if base and all(x.isalnum() for x in base) else " "
    table.update({ord(a): b for a, b in zip("0134578@$€†|¡!", "oieastbaset" + "iii")})
    table.update({ord(a): "" for a in "\ufffd'’‘`´*#?­​‌‍⁠﻿"})
    table.update({ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d", ord("\n"): "\n"})
    # letters of one shape, whatever their script
    table.update({ord(a): b for a, b in zip("аеёорсухіјѕһαοερνικυ", "aeeopcyxijshaoepvikv")})
    # letters that scanning confuses get one form: l, h and i; c and e; m and rn; w and vv
    close = {"l": "i", "h": "i", "e": "c", "m": "rn", "w": "v"}
    return {k: "".join(close.get(c, c) for c in v) for k, v in table.items()}


FOLD = _folding()
RUNS = re.compile(r"(.)\1+")


def fold(text: str) -> str:
    """Folded words, still apart."""
    return text.lower().translate(FOLD)


def squash(folded: str) -> str:
    """Folded text without blanks and with single letters, in which split, spaced and stretched words look alike."""
    return RUNS.sub(r"\1", "".join(folded.split()))


def spoken_lines(text: str) -> list[str]:
    """Lines of the cues as one reads them: right encoding, no markup; a line that runs on over the next cue is one line."""
    if not text.isascii():
        text = "\n".join([x if x.isascii() else unbroken(x) for x in text.splitlines()])
    comments = text.lstrip("\ufeff \n\r").startswith("WEBVTT")
    text = TAGS.sub("", text)
    out: list[str] = []
    open_end = False
    for line in text.splitlines():
        line = line.strip()
        if not line or NOT_SPOKEN.fullmatch(line) or (comments and line.startswith("NOTE ")):
            continue
        bare = line.lstrip("-–— ")
        if out and (open_end or bare.startswith(("...", "…"))):
            out[-1] = out[-1].rstrip(".… ") + " " + bare.lstrip(".… ")
        else:
            out.append(line)
        open_end = line.endswith(("...", "…"))
    return out


ACCENTED = re.compile(r"[à-ÿœ]")

# ---- votes ------------------------------------------------------------------------------------------------------------


#: Letters of a word set apart by blanks, and how far apart, in characters, words may be that make a general voter fire.
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
NEAR = 60


class Voters:
    """Votes by the kinds of words that lie near each other, of one language at a time."""

    def __init__(self):
        import ahocorasick

        self.kinds = sorted({k for own in WORDS.values() for k in own})
        width = len(self.kinds)
        whole: dict[str, int] = {}
        for i, (lang, own) in enumerate(WORDS.items()):
            for kind, words in own.items():
                bit = 1 << (i * width + self.kinds.index(kind))
                for word in words.split(", "):
                    # accented letters are those that damage loses
                    bare = ACCENTED.sub("", word)
                    for form in {word, bare} if len(bare.rstrip("*")) > 5 else {word}:
                        stem = RUNS.sub(r"\1", " ".join(fold(form.rstrip("*")).split()))
                        key = stem if lang == "ja" else f" {stem}" + ("" if word.endswith("*") else " ")
                        whole[key] = whole.get(key, 0) | bit
        self.machine, self.loose = ahocorasick.Automaton(), ahocorasick.Automaton()
        for key, bits in whole.items():
            self.machine.add_word(key, bits)
            # where blanks tell no words apart, only longer ones are looked for
            if len(bare := key.replace(" ", "")) >= 4:
                self.loose.add_word(bare, self.loose.get(bare, 0) | bits)
        self.machine.make_automaton()
        self.loose.make_automaton()
        self.known: dict[int, int] = {}
        self.masked = 1 << (len(VOTERS) - 1)

    def fired(self, near: int) -> int:
        """Bits of the voters that fire for the kinds found near each other."""
        if near not in self.known:
            out, rest, each = 0, near, []
            while rest:
                each.append({k for i, k in enumerate(self.kinds) if rest >> i & 1})
                rest >>= len(self.kinds)
            # languages share words: what condemns in one doesn't insult in its neighbour
            condemned = {"against"} if any("against" in own for own in each) else set()
            for own in each:
                own |= condemned
                bare = own - {"against", "plain"}
                for name, rule in RULES.items():
                    if rule(own):
                        out |= 1 << VOTERS.index(name)
                    elif rule(bare):
                        for other, kind in AGAINST.items():
                            out |= (kind in own) << VOTERS.index(other)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[near] = out
        return self.known[near]

    def votes(self, folded: list[str]) -> list[int]:
        """The votes of each line, given its folded words."""
        texts, ends, total = [], [], 0
        found: list[tuple[int, int]] = []
        for x in folded:
            t = x
            if SPACED.search(x):
                for m in SPACED.finditer(x):
                    found += [(total + min(m.start(), len(x)), bits) for _, bits in self.loose.iter(RUNS.sub(r"\1", m[0].replace(" ", "")))]
                # and as one word, among its neighbours
                t = SPACED.sub(lambda m: m[0].replace(" ", ""), x)
            t = f" {RUNS.sub(r"\1", t)} "
            total += len(t) + 1
            texts.append(t)
            ends.append(total)
        found += [(end, bits) for end, bits in self.machine.iter("\n".join(texts))]
        found.sort()
        out = [0] * len(folded)
        begin = 0
        while begin < len(found):
            line = bisect_right(ends, found[begin][0])
            stop = bisect_right(found, ends[line] - 1, begin, key=lambda x: x[0])
            # the words at most NEAR before or after each word, by how often each set of kinds is among them
            first = last = begin
            around: dict[int, int] = {}
            for at, _ in found[begin:stop]:
                while last < stop and found[last][0] <= at + NEAR:
                    around[found[last][1]] = around.get(found[last][1], 0) + 1
                    last += 1
                while found[first][0] < at - NEAR:
                    if around[found[first][1]] == 1:
                        del around[found[first][1]]
                    else:
                        around[found[first][1]] -= 1
                    first += 1
                near = 0
                for bits in around:
                    near |= bits
                out[line] |= self.fired(near)
            begin = stop
        return out

    def vote(self, text: str) -> list[tuple[int, str]]:
        """Each line's votes, as bits, and its folded words."""
        lines = spoken_lines(text)
        if not lines:
            return []
        masked = [0] * len(lines)
        for i, line in enumerate(lines):
            if "*" in line:
                lines[i], hit = unmasked(line)
                masked[i] = self.masked * hit
        folded = [" ".join(x.split()) for x in fold("\n".join(lines)).split("\n")]
        return [(a | b, x) for a, b, x in zip(masked, self.votes(folded), folded)]


_VOTERS: list[Voters] = []


def voters() -> Voters:
    if not _VOTERS:
        _VOTERS.append(Voters())
    return _VOTERS[0]


def voted_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, and for each line its ``votes`` and folded ``words``, as arrays; no lines for null or blank texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = voters()
        for pdf in frames:
            found = [v.vote(t) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "votes": [[a for a, _ in x] for x in found], "words": [[b for _, b in x] for x in found]})

    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), cleaned(F.col(source)).alias("source"), F.col(text).alias("text"))
    return own.mapInPandas(run, f"doc_id {id_type}, source string, votes array<bigint>, words array<string>")


# ---- label model --------------------------------------------------------------------------------------------------------


SIDE = np.array([-1.0 if v in AGAINST else 1.0 for v in VOTERS])
#: Before any data each voter counts as right in nine of ten lines, as if seen on so many lines or on this share of its own.
BELIEVED, PRIOR_LINES, PRIOR_SHARE = 0.9, 20.0, 0.25
#: Share of the lines with such content that no voter is taken to know (see the held-out lines in ``tests/llm``).
MISSED = 0.1


class LabelModel:
    """How often each voter that votes is right, the weight that its correlation with others leaves it, and the class priors.

    A voter speaks for one side or not at all; that it stays silent says nothing. ``prior`` is the share of such content among the
    lines with a vote, ``unvoted`` that among the others. By itself a voter leaves a line with the chance that it is right, and each
    further one multiplies the odds by its own over the prior's; of correlated ones the best counts whole and the others by their weight.
    """

    def __init__(self, right: np.ndarray, weight: np.ndarray, prior: float, unvoted: float):
        self.right, self.weight, self.prior, self.unvoted = right, weight, prior, unvoted

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Probability of such content for rows of 0 and 1, one column for each voter."""
        odds, base = np.log(self.right / (1 - self.right)), np.log(self.prior / (1 - self.prior))
        z = np.zeros(len(fired))
        for side in (1.0, -1.0):
            own = fired * self.weight * (SIDE == side)
            first = own.max(1)
            z += side * np.where(first > 0, own @ (odds - side * base) / np.maximum(first, 1e-9) + side * base, 0.0)
        return np.where(fired.any(1), 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.unvoted)


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS))[None, :] & 1).astype(float)


def fit_label_model(patterns: DataFrame, rounds: int = 100) -> LabelModel:
    """Expectation maximisation over ``patterns`` (``votes``, ``n``), the counts of all lines of the corpus by their votes.

    Each round is a Spark job that sums posterior-weighted counts over the patterns; only sums by voter and by pair of
    voters come back; rounds end once nothing changes. Voters that contradict better or more numerous ones lose accuracy, those that agree
    gain. How much oftener two voters fire together within a class than their rates explain is their correlation; in every
    round a voter's weight is divided by one plus the sum of its correlations, so that voters that say the same count about once.
    """
    m = len(VOTERS)
    silent = patterns.where("votes = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = LabelModel(np.full(m, BELIEVED), np.ones(m), 0.5, 0.0)
    for _ in range(rounds):
        now = model

        def sums(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + 2 * m + 2 * m * m)
            for pdf in frames:
                x, n = _bits(pdf["votes"].to_numpy()), pdf["n"].to_numpy(float)
                p = now.posterior(x)
                for c, w in enumerate(((1 - p) * n, p * n)):
                    total[c] += w.sum()
                    total[2 + c * m : 2 + (c + 1) * m] += w @ x
                    at = 2 + 2 * m + c * m * m
                    total[at : at + m * m] += ((x * w[:, None]).T @ x).ravel()
            yield pd.DataFrame({"k": [total.tolist()]})

        parts = patterns.where("votes <> 0").mapInPandas(sums, "k array<double>").select(F.posexplode("k")).groupBy("pos").agg(F.sum("col").alias("s"))
        got = dict(parts.collect())
        total = np.array([got.get(i, 0.0) for i in range(2 + 2 * m + 2 * m * m)])
        lines, fired = total[:2] + 1.0, total[2 : 2 + 2 * m].reshape(2, m)
        good, all_ = np.where(SIDE > 0, fired[1], fired[0]), fired.sum(0)
        belief = np.maximum(PRIOR_LINES, PRIOR_SHARE * all_)
        right = np.clip((good + BELIEVED * belief) / (all_ + belief), 0.01, 0.999)
        prior = float((lines[1] + PRIOR_LINES) / (lines.sum() + 2 * PRIOR_LINES))
        unvoted = float(np.clip(total[1] * MISSED / (1 - MISSED) / max(1, silent), 1e-6, prior))
        rate = fired / lines[:, None]
        cov = total[2 + 2 * m :].reshape(2, m, m) / lines[:, None, None] - rate[:, :, None] * rate[:, None, :]
        dev = np.sqrt(np.maximum(rate * (1 - rate), 0)) + 1e-9
        rho = (cov / (dev[:, :, None] * dev[:, None, :]) * (lines / lines.sum())[:, None, None]).sum(0)
        np.fill_diagonal(rho, 0)
        model = LabelModel(right, 1 / (1 + np.maximum(rho, 0).sum(1)), prior, unvoted)
        if np.abs(model.right - now.right).max() < 1e-3 and np.abs(model.weight - now.weight).max() < 1e-3 and abs(prior - now.prior) < 1e-3:
            break
    return model


# ---- linear classifier ----------------------------------------------------------------------------------------------------


#: Weight of a line without a vote.
UNVOTED = 0.2
FOR_BITS = sum(1 << j for j in range(len(VOTERS)) if SIDE[j] > 0)
AGAINST_BITS = sum(1 << j for j in range(len(VOTERS)) if SIDE[j] < 0)


def features(votes: int, words: str) -> set[str]:
    """Names of a line's features: voters that fired, whether any did on either side, words and pairs of words."""
    w = words.split()
    out = set(w)
    out.update([f"{a} {b}" for a, b in zip(w, w[1:])])
    if votes & FOR_BITS:
        out.add("#for")
    if votes & AGAINST_BITS:
        out.add("#against")
    j = 0
    while votes:
        if votes & 1:
            out.add(f"#{j}")
        votes >>= 1
        j += 1
    return out


class Linear:
    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, votes: int, words: str) -> float:
        get = self.weights.get
        return self.intercept + sum([get(x, 0.0) for x in features(votes, words)])


def fit_linear(lines: DataFrame, patterns: DataFrame, model: LabelModel, fit_lines: int = FIT_LINES, least_lines: int = 3) -> Linear:
    """Logistic regression on the posterior labels of at most ``fit_lines`` lines, a seeded sample drawn evenly by hash.

    Lines without a vote, which may hold what no voter knows, count ``UNVOTED`` as much as others.

    ``lines`` has ``doc_id``, ``votes`` and ``words``. Each line enters once with either label,
    weighted by its posterior, lines without a vote too. ``patterns`` says how many lines there are, so that all but about twice the wanted number are
    filtered out by their key before any are gathered. Features on fewer than ``least_lines`` of those lines are left out.
    """
    spark = lines.sparkSession
    key = random_key(23, F.col("doc_id"), F.col("words"))
    half = fit_lines // 2
    sizes = dict(patterns.groupBy((F.col("votes") != 0).alias("v")).agg(F.sum("n")).collect())
    chosen = []
    for voted in (True, False):
        share = min(1.0, (2 * half + 1000) / max(1, sizes.get(voted, 0)))
        own = lines.where((F.col("votes") != 0) == voted).withColumn("_key", key).where(uniform(F.col("_key")) <= share)
        chosen.append(own.orderBy("_key", "doc_id", "words").limit(half).drop("_key"))
    sample = chosen[0].unionAll(chosen[1]).select("votes", "words").toPandas()
    if not len(sample):
        return Linear({}, -10.0)
    p = model.posterior(_bits(sample["votes"].to_numpy()))
    sets = [features(int(v), w) for v, w in zip(sample["votes"], sample["words"])]
    counts: dict[str, int] = {}
    for s in sets:
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    names = sorted(x for x, n in counts.items() if n >= least_lines)
    at = {x: i for i, x in enumerate(names)}
    rows = []
    for s, q, w in zip(sets, p, np.where(sample["votes"].to_numpy() == 0, UNVOTED, 1.0)):
        where = sorted(at[x] for x in s if x in at)
        v = SparseVector(max(1, len(names)), where, [1.0] * len(where))
        rows += [(label, weight, v) for label, weight in ((1.0, float(q * w)), (0.0, float((1 - q) * w))) if weight > 0]
    if len({r[0] for r in rows}) < 2:
        return Linear({}, -10.0 if rows[0][0] == 0 else 10.0)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("features", VectorUDT())])
    data = spark.createDataFrame(rows, schema).repartition(8).cache()
    fitted = LogisticRegression(weightCol="w", regParam=2e-4, maxIter=60, standardization=False).fit(data)
    data.unpersist()
    coef = fitted.coefficients.toArray()
    return Linear({x: float(coef[i]) for x, i in at.items() if abs(coef[i]) > 1e-4}, float(fitted.intercept))


# ---- scores -----------------------------------------------------------------------------------------------------------------


def content_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", fit_lines: int = FIT_LINES) -> DataFrame:
    """``doc_id``, ``source`` and ``score`` of every document: the highest score, from 0 to 1, of its lines.

    Voters see all lines of whole texts, and the label model counts them all; only the linear classifier is fitted on a
    bounded sample. Null, empty and blank texts, and texts without spoken lines, score 0. Repeated rows are scored alike;
    sources are cleaned of letter case and surrounding blanks, null stays null.
    """
    spark = docs.sparkSession
    # as columns in the shared folder: what reads the votes alone leaves the words on disk
    voted = stored(voted_lines(docs, doc_id, text, source))
    lines = voted.select("doc_id", F.explode(F.arrays_zip("votes", "words")).alias("x")).select("doc_id", "x.votes", "x.words")
    patterns = cut(lines.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    model = fit_label_model(patterns)
    sent = spark.sparkContext.broadcast(fit_linear(lines, patterns, model, fit_lines))

    @F.pandas_udf("double")
    def score(votes: pd.Series, words: pd.Series) -> pd.Series:
        linear = sent.value
        best = [max([linear.score(int(a), b) for a, b in zip(v, w)], default=None) for v, w in zip(votes, words)]
        return pd.Series([0.0 if z is None else 1 / (1 + np.exp(-min(max(z, -60.0), 60.0))) for z in best])

    return voted.select("doc_id", "source", score("votes", "words").alias("score"))


def flagged(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.where(F.col("score") >= threshold)


def source_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``source`` (null too), ``docs``, ``flagged`` and ``rate``."""
    hit = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), hit.alias("flagged"), (hit / F.count(F.lit(1))).alias("rate"))
