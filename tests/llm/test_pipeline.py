"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import re
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import xxhash

import corpus_pipeline
import public_tokenizers
from labelaudit.llm import bpe, fertility, secret_scan

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def good(text, lang):
    words = WORDS.findall(text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(grams)
    repeat = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)})
    if len(words) < 20 or 100 * repeat > 30 * len(words):
        return False
    ids = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(text)
    n, share = len(ids), np.array(list(Counter(ids).values())) / len(ids)
    slack = fertility.SLACK / n**0.5
    low, high = fertility.LANGUAGE_BANDS[lang]
    entropy = -(share * np.log2(share)).sum() / np.log2(min(n, 4096))
    return (
        low - slack <= len(text) / n <= high + slack
        and sum(3 <= i < 259 for i in ids) / n <= 0.03 + slack
        and entropy >= fertility.MIN_ENTROPY
    )


def fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if words else 0


def firsts(docs):
    """Smallest ids of the groups linked at three bits."""
    prints = {d: fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    first = {d: d for d in prints}
    while True:
        new = {a: min(first[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == first:
            return set(first.values())
        first = new


def clean(text):
    tails = [(m.start(1), m.end(1)) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]  # fmt: skip
    tails += [(m.start() + 4, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    tails += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for low, high in sorted(secret_scan._joined(tails), reverse=True):
        text = text[:low] + "[secret]" + text[high:]
    return text


def copies(docs):
    """How often the mix takes each document."""
    size = docs.text.map(lambda t: len(WORDS.findall(t)))
    total = size.groupby(docs.source).sum()
    weight = pd.Series({s: i % 3 + 1 for i, s in enumerate(sorted(total.index))})
    stopped = pd.Series(False, total.index)
    while True:
        level = (total.sum() - 3 * total[stopped].sum()) / weight[~stopped].sum()
        over = weight * level > 3 * total
        if (over == stopped).all():
            break
        stopped = over
    rate = pd.Series(np.where(stopped, 3.0, weight * level / total), total.index)
    out = []
    for d, t, s in zip(docs.doc_id, docs.text, docs.source):
        draw = int(md5(f"mix:{d}:{t}".encode()).hexdigest()[:13], 16) / 2**52
        out.append(int(rate[s]) + (draw < rate[s] - int(rate[s])))
    return out


def test_pipeline(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = docs[[good(t, x) for t, x in zip(docs.text, docs.lang)]]
    docs = docs[docs.doc_id.isin(firsts(docs))]
    docs = docs.assign(text=docs.text.map(clean))
    path, pattern = bpe.production()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = Counter()
    for d, s, t, n in zip(docs.doc_id, docs.source, docs.text, copies(docs)):
        want[d, s, tuple(encoding.encode_ordinary(t))] += n
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in rows) == +want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixture", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
