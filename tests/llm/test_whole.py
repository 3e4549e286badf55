"""Whole results on the rows that earlier rules lost, against brute force."""

import random
import string
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioweave.llm import secrets, tokens
from folioweave.llm.queries import tokenizer_path


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a<|endoftext|>b", "plain words", " <|endoftext|> ", "<|endoftext|><|endoftext|>", "<|endoftext| >", "ünï 中<|endoftext|> more", "some words and more words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at, expected = 0, []
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, tokens.END]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    found = tokens.token_output(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == expected


def test_every_class_of_secrets_is_reachable(spark):
    rng = random.Random(3)
    key, other = "q7Xv2LmP9sRt4WzB8kNd3HfG", "Qm3Zr8Tn5Vc1Yk6Lw0Jd9B"
    random_ = [("".join(rng.choices(letters, k=n)), n) for letters in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef" + "ABCDEF") for n in (20, 40) for _ in range(100)]
    random_ += [("".join(rng.choices(string.digits, k=20)), 20) for _ in range(100)]
    found_ = ["b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW", *(key + hit + other for hit in ("your", "xxxx", "sample"))]
    none = ["internationalization/of/everything", "the_quick_brown_fox_jumps", "getUserAccountInformation", "YOUR_API_KEY_PLACEHOLDER", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "01234567890123456789", "a" * 30, "-" * 30]
    rows = [x for x, _ in random_] + found_ + none
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    made = secrets.find_secrets(docs).select("doc_id", F.expr("exists(spans, s -> s.kind = 'entropy' and s.start = 0)").alias("hit"))
    hit = [r["hit"] for r in made.orderBy("doc_id").collect()]
    for i in range(0, len(random_), 100):
        assert sum(hit[i : i + 100]) >= 85, random_[i]
    by_class = [sum(hit[i : i + 200]) / 200 for i in range(0, len(random_) - 100, 200)] + [sum(hit[len(random_) - 100 : len(random_)]) / 100]
    assert min(by_class) >= 0.9, by_class
    assert hit[len(random_) :] == [True] * len(found_) + [False] * len(none)
