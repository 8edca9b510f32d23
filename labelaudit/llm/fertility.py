"""Quality rules: tokeniser fertility of a public vocabulary.

A vocabulary cuts each text into tokens, and three figures tell whether the text is
the kind of language that the vocabulary knows: characters per token, the share of
tokens that are fallback bytes, and the entropy of the tokens over the largest that
a text of this length can have (the length counts up to 4,096 tokens, beyond which
entropy no longer rises with it). Each language has a band of characters per token;
a text in another or no language goes by its script. Bands widen by
``slack / sqrt(tokens)``, since short texts give noisy figures.

Defined results: a missing or empty text has no words and no tokens and fails the
base rules; equal rows get equal verdicts; an empty table gives an empty result.
Texts are read whole, one at a time, in a map without any shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.llm.frames import hidden, made_of, map_texts, shown

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Characters per token of prose in the production vocabulary, by language: from made-up words to literature.
LANGUAGE_BANDS = {"en": (2.50, 5.5), "de": (2.50, 5.5), "fr": (2.22, 5.0), "es": (2.18, 5.0)}
#: The same by script, for other languages: wide, as languages of a script differ.
SCRIPT_BANDS = {"Latin": (1.6, 5.5), "Cyrillic": (1.2, 4.5), "Greek": (0.9, 3.5), "Han": (0.4, 2.5), "other": (0.25, 8.0)}
#: The most fallback bytes; scripts without pieces of their own are written in bytes.
MAX_BYTE_SHARE = {"Han": 0.9, "Greek": 0.5, "other": 1.0}
DEFAULT_BYTE_SHARE = 0.03
MIN_ENTROPY = 0.46
#: The least entropy of scripts written letter by letter or in bytes, which have few different tokens however long the text.
SCRIPT_MIN_ENTROPY = {"Greek": 0.28, "Han": 0.28, "other": 0.18}
ENTROPY_TOKENS = 4096
SLACK = 1.3

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double"
)
_WORD_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for j in range(width):
        windows = windows * _WORD_MIX + h[j : j + n]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = text.split()
    tails = text.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100)))  # continuation bytes
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        sum(map(len, words)) - len(tails),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str) -> tuple[Callable[[str], list[int]], range]:
    """Encode function and the ids of fallback bytes: a sentencepiece model or a rank file."""
    import base64

    if vocabulary.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        bytes_ = [i for i in range(pieces.vocab_size()) if pieces.is_byte(i)]
        return lambda text: pieces.encode(text, num_threads=1), range(bytes_[0], bytes_[-1] + 1)
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = [r for t, r in ranks.items() if len(t) == 1 and t[0] >= 0x80]  # parts of a character
    return encoding.encode_ordinary, range(min(split), max(split) + 1)


def fertility(text: str, vocabulary: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of fallback bytes, entropy of its largest value."""
    encode, fallback = tokenizer(vocabulary)
    ids = encode(text)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = Counter(ids)
    spread = math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    most = math.log2(min(n, ENTROPY_TOKENS))
    return (
        n,
        len(text) / n,
        sum(c for i, c in counts.items() if i in fallback) / n,
        min(1.0, spread / most) if most else 0.0,
    )


def production_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _measures(vocabulary: str | None) -> Callable[[list[bytes]], dict[str, list]]:
    """The MEASURES of a list of texts. The vocabulary's path is the same on all machines."""
    path = vocabulary or production_vocabulary()
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def run(texts: list[bytes]) -> dict[str, list]:
        rows = [(*base(t), *fertility(t.decode(), path)) for t in texts]
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    return run


def measure(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and the MEASURES of each text."""
    return map_texts(docs, text, keep, MEASURES, _measures(vocabulary))


def band_of(lang: Column, text: Column) -> Column:
    """The language if it has a band, else the script that more than half of all letters are of, else "other"."""
    scripts = [s for s in SCRIPT_BANDS if s != "other"]
    counted = F.array(
        *[F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(s).alias("s")) for s in scripts]
    )
    most = F.array_max(counted)
    by_script = F.when(most["n"] * 2 > F.regexp_count(text, F.lit(r"\p{L}")), most["s"]).otherwise("other")
    return F.when(lang.isin(*LANGUAGE_BANDS), lang).otherwise(F.coalesce(by_script, F.lit("other")))


def _looked_up(band: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for key, value in values.items():
        out = F.when(band == key, float(value)).otherwise(out)
    return out


def judge(measured: DataFrame, band: str) -> DataFrame:
    """Add base_failed and kept; ``band`` is a column made by :func:`band_of`."""
    bands = {**LANGUAGE_BANDS, **SCRIPT_BANDS}
    slack = F.lit(SLACK) / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )

    def inside(own: Column) -> Column:
        low = _looked_up(own, {k: v[0] for k, v in bands.items()}, 0.0)
        high = _looked_up(own, {k: v[1] for k, v in bands.items()}, 99.0)
        return (
            F.col("chars_per_token").between(low - slack, high + slack)
            & (F.col("byte_share") <= _looked_up(own, MAX_BYTE_SHARE, DEFAULT_BYTE_SHARE) + slack)
            & (F.col("entropy") >= _looked_up(own, SCRIPT_MIN_ENTROPY, MIN_ENTROPY))
        )

    # a variable, so that the band of a text is found once however often it is compared
    kept = ~failed & F.exists(F.array(band), inside)
    return measured.withColumns({"base_failed": failed, "kept": kept})


def score(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``keep`` columns, the measures, base_failed and kept of every document."""
    rows = docs.withColumn("_band", band_of(docs[lang], docs[text]))
    return judge(measure(rows, [*keep, "_band"], text, **options), "_band").drop("_band")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """The documents kept, with their columns as they are. Only the texts go through Python, and only verdicts come back."""
    rows, names = hidden(docs)
    made = made_of(rows[names[text]], MEASURES, _measures(vocabulary), done=tokenizer.cache_clear)
    measured = rows.select("*", band_of(rows[names[lang]], rows[names[text]]).alias("_band"), made.alias("_made"))
    scored = judge(measured.select("*", "_made.*"), "_band")
    return shown(scored.where("kept"), names)
