"""Encoding, mixtures and content scores."""

from collections import Counter

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm import abuse, mixture, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.vocabulary())


@pytest.fixture(scope="module")
def reference(enc):
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\r\t'sétSЖ\x1c\x1f\x85\xa0　😀<|endoftext|>\x00日本٣Ⅷ­​.-:,"), max_size=60))
def test_encoding_is_the_public_one(enc, reference, text):
    assert enc.encode(text) == reference.encode_ordinary(text)
    assert enc.count(text) == len(enc.encode(text))


def test_long_words(enc, reference):
    for w in ("ab" * 4000, "é" * 3000, "x" * 20_000, "".join(random.Random(1).choices("abcdefgh", k=9000))):
        assert enc.encode(w) == reference.encode_ordinary(w)
        assert enc._heap(w[:300].encode()) == enc._scan(w[:300].encode())


def test_documents(spark):
    hf = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids"))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (hf.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


def test_text_dirt(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "a<|endoftext|>")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokens.token_ids(docs).collect()), key=str)
    assert [x[1] for x in got if x[0] in (1, 2)] == [[], []] and sum(x[0] == 3 for x in got) == 2
    assert 50256 not in [i for x in got if x[0] == 0 for i in x[1]]
    assert tokens.token_ids(docs.limit(0)).count() == 0
    assert {r["tokens"] for r in tokens.token_counts(docs.limit(2), ["doc_id"]).collect()} == {0}


def test_texts_come_back(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "naïve Straße\r\n\tкот 日本 😀"), (3, "x" * 5000), (None, "a")], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["text"]) for r in tokens.token_texts(tokens.token_ids(docs)).collect())
    assert got == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, tokens.encoder(tokens.vocabulary()).encode("😀")[:1])], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.token_texts(odd).collect()} == {1: None, 2: "", 3: "\ufffd"}


def test_fit_budget():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 5)
        lengths, counts = rng.sample(range(1, 30), n), [rng.randint(0, 4) for _ in range(n)]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 3)
        got = mixture.fit_budget(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(got, counts)) and sum(a * b for a, b in zip(lengths, got)) <= budget
    assert mixture.fit_budget([3, 5, 7], [10, 10, 10], 71) and sum(a * b for a, b in zip([3, 5, 7], mixture.fit_budget([3, 5, 7], [10, 10, 10], 71))) == 71
    many = mixture.fit_budget(list(range(1, 3000)), [9] * 2999, 12_345_678)
    assert sum(a * b for a, b in zip(range(1, 3000), many)) == 12_345_678
    assert mixture.fit_budget([], [], 5) == [] and mixture.fit_budget([4], [2], 0) == [0] and mixture.fit_budget([4], [2], 99) == [2]
    # a budget above what the fit holds at once is brought down by whole documents first
    far = mixture.fit_budget([70_000, 90_000], [5, 5], 400_000)
    assert sum(a * b for a, b in zip([70_000, 90_000], far)) <= 400_000


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 40), rng.choice(["A", " a", "b", "c ", None, "zz"]), "clash") for i in range(900)] + [(1000, None, "a", ""), (1001, "", "b", ""), (1002, "tiny", "d", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("B", 0.3, 2), ("c", 0.25, 9), ("d", 0.1, 3), ("e", 0.05, 2), (None, 0.5, 1), ("b", None, None)], "source string, weight double, max_repeats int")
    mix, report = mixture.mixture(docs, targets)
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == set("abcde")
    assert {s for s, r in told.items() if r["unmet"]} == {"d", "e"}
    for s in "abc":
        r = told[s]
        assert 0 <= r["budget"] - r["mixed"] < 2 or r["mixed"] == r["max_repeats"] * r["own"]
    assert told["d"]["mixed"] == 3 * told["d"]["own"] and told["e"]["mixed"] == 0
    assert abs(sum(r["share"] for r in told.values()) - 1) < 1e-9
    got = mix.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= told[r["source"]]["max_repeats"] for r in got)
    mix, report = mixture.mixture(docs.limit(0), targets)
    assert mix.count() == 0 and report.count() == 5
    mix, report = mixture.mixture(docs, targets.limit(0))
    assert mix.count() == 0 and report.count() == 0


BAD = ["Crawl back in your hole, you filthy whore.", "Verpiss dich, du dumme Schlampe.", "Te voy a rajar mientras duermes, hijo de puta.", "Casse-toi, fils de pute.", "Ты просто кусок дерьма.", "死ね、リンコ。誰も悲しまない。", "Take off your panties and spread your legs for me."]
FINE = ["The bitch had six puppies at noon.", "To hell with it, let's go home.", "Hatred of foreigners is a sickness.", "Don't ever call your brother an idiot.", "You can see it with the naked eye.", "Die Hündin hat sechs Welpen.", "Where is Milo?"]


def damaged(line, rng):
    """One of the disguises and damages that cues show."""
    kind = rng.randint(0, 5)
    words = line.split(" ")
    i = max(range(len(words)), key=lambda j: (len(words[j]), j))
    w = words[i]
    if kind == 0:
        words[i] = " ".join(w)
    elif kind == 1:
        words[i] = "-".join(w)
    elif kind == 2:
        words[i] = w.translate(str.maketrans("aeio", "4310"))
    elif kind == 3:
        words[i] = w[:1] + w[1] * 4 + w[2:]
    elif kind == 4:
        words[i] = w[:3] + "​" + w[3:]
    else:
        return line.translate(str.maketrans({"l": "I", "e": "c"})).replace("h", "li", 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(700):
        body = [rng.choice(FINE) + f" {rng.randint(1, 9)}" for _ in range(4)]
        bad = i % 3 == 0
        if bad:
            line = rng.choice(BAD)
            body.insert(2, damaged(line, rng) if i % 2 else line)
        text = "\n\n".join(f"{n}\n00:00:0{n},000 --> 00:00:0{n},900\n<i>{x}</i>" for n, x in enumerate(body, 1))
        rows.append((i, text, rng.choice([" Pool", "pool", "rips", None]), 5))
        truth[i] = bad
    rows += [(9000, None, "rips", 1), (9001, "", None, 1), (9002, " \n ", "rips", 1), (9003, "go " * 200_000 + "fuck you, you filthy whore", "rips", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, votes int")
    return docs, truth, abuse.content_scores(docs).persist()


def test_content_scores(scored):
    _, truth, scores = scored
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert len(got) == 704 and all(0 <= s <= 1 for s in got.values())
    assert all(got[i] == 0 for i in (9000, 9001, 9002)) and got[9003] >= 0.5
    hit = [got[i] >= 0.5 for i in truth]
    assert sum(h and b for h, b in zip(hit, truth.values())) / sum(truth.values()) > 0.93
    assert sum(h and not b for h, b in zip(hit, truth.values())) == 0
    assert {r["source"] for r in abuse.source_rates(scores).collect()} == {"pool", "rips", None}


def test_scores_of_nothing(scored):
    docs, _, _ = scored
    assert abuse.content_scores(docs.limit(0)).count() == 0
    assert abuse.flagged(abuse.content_scores(docs.where("doc_id >= 9000 AND doc_id < 9003"))).count() == 0


def test_lines():
    t = "12\r\n00:01:02,000 --> 00:01:04,000\r\n{\\an8}<b>Crawl back in ...</b>\r\n\r\n13\r\n00:01:05,000 --> 00:01:06,000\r\n... your hole.\r\nSchlieÃŸ die TÃ¼r"
    assert abuse.spoken_lines(t) == ["Crawl back in your hole.", "Schließ die Tür"]
    for good, codec in (("Ты просто кусок дерьма.", "cp1251"), ("Заткнись, Лука", "cp1251")):
        assert abuse.unbroken(good.encode(codec).decode("cp1252", "replace")) == good
    lossy = "Ты просто грязная сука.".encode().decode("cp1252", "replace")
    assert "\ufffd" in lossy and "просто гр" in abuse.unbroken(lossy) and "сука" in abuse.unbroken(lossy)
    assert abuse.unbroken("Schließ die Tür\ufffd") == "Schließ die Tür\ufffd" and abuse.unbroken("Où êtes-vous né ?") == "Où êtes-vous né ?"
    votes = abuse.voters().vote("Niemand w?rde dich vermissen, Odo.\nL\ufffdrgate, hijo de puta.")
    assert [bool(v) for v, _ in votes] == [True, True]
    assert abuse.unbroken("EstГЎ extraГ±o") == "Está extraño" and abuse.unbroken("über") == "über" and abuse.unbroken("Чтоб ты") == "Чтоб ты"


def test_label_model_learns_who_is_right(spark):
    """A voter that fires where many others say the opposite ends as one that says little; the share of such lines is learned."""
    a, b, c, d = (1 << abuse.VOTERS.index(x) for x in ("threat", "scorn", "condemns", "arson"))
    patterns = spark.createDataFrame([(a | b, 300), (a, 100), (b, 100), (a | b | c, 50), (d, 20), (c | d, 200), (c, 800), (0, 90_000)], "votes bigint, n bigint")
    model = abuse.fit_label_model(patterns)
    right = dict(zip(abuse.VOTERS, model.right))
    assert right["threat"] > 0.9 and right["arson"] < 0.7 < right["condemns"]
    # 550 of 1,570 lines with a vote, and a share of that among the others
    assert 0.25 < model.prior < 0.45 and 1e-5 < model.unvoted < 0.01
    p = model.posterior(abuse._bits(__import__("numpy").array([a | b, a, c | d, 0])))
    assert p[0] > 0.9 and p[1] > 0.5 and p[2] < 0.3 and p[3] == model.unvoted
    assert dict(zip(abuse.VOTERS, model.weight))["threat"] <= 1.0
