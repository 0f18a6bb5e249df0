import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.distance import Scanner, deletions, osa, osa_pairs
from plumbline.functions.values import clean_values

CASES = {
    "Solène": "solene", "ﬂat": "flat", "Bjørn Đuro Weiß Pæl Œuf": "bjorn duro weiss pael oeuf", "half-open": "half open", "a·b": "a b", "SaltRoad": "salt road",
    "eBay": "e bay", "HTTP": "http", "4K": "4k", "baker's dozen": "bakers dozen", "Chloé’s drum": "chloes drum", "?!": "", "": "", "d'Arc": "d arc",
    "D'Arc": "darc", "½ ™": "tm", "éB": "e b", "ВижуМир": "вижу мир", "ΣΑΣ": "σασ", "ẚA": "aʾ a", "İ": "i",
}


@pytest.mark.parametrize("given", CASES)
def test_terms(given):
    assert text.terms(given) == CASES[given].split()
    assert [t[0] for t in text.tokens(given)] == CASES[given].split()


def test_both_tokenizers_agree():
    rng = random.Random(1)
    pool = [chr(i) for i in [*range(1, 0x600), *range(0x1E00, 0x2200), *range(0x3040, 0x3100), *range(0xFF00, 0xFF9F), 0x1D400, 0xFB01]]
    for _ in range(20_000):
        s = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abAB '’1é́") for _ in range(rng.randint(0, 8)))
        assert text.terms(s) == [t[0] for t in text.tokens(s)], ascii(s)


def test_offsets():
    assert [t[1:] for t in text.tokens("Salt, bread & oil")] == [(0, 4), (6, 11), (14, 17)]
    assert text.tokens("Solène's drum")[0] == ("solenes", 0, 8) and text.tokens("e\u0301a b")[0] == ("ea", 0, 3)
    assert text.terms(None) == [] and text.tokens(None) == []
    assert len(text.terms("word " * 200_000)) == 200_000


def test_small_functions():
    assert text.normalize_word("D'Arçy!") == "darcy" and text.capitalize("two words") == "Two words"
    raw = """<b id="1">salt & 'oil'</b>"""
    assert text.escape_html(raw) == "&lt;b id=&quot;1&quot;&gt;salt &amp; &#39;oil&#39;&lt;/b&gt;" and text.unescape_html(text.escape_html(raw)) == raw
    assert (text.format_int(1234567), text.format_ms(123.4), text.format_ms(12.34), text.format_ms(1.234)) == ("1,234,567", "123", "12.3", "1.23")


def _osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance():
    assert (osa("no", "on"), osa("ketlte", "kettle"), osa("saddle", "paddles"), osa("ca", "abc"), osa("abcdef", "x", 2)) == (1, 1, 2, 3, 3)
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in "ab") for _ in range(2000)]
    assert osa_pairs(*map(list, zip(*pairs))).tolist() == [_osa(*p) for p in pairs]


def test_scanned_distances(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 5, 8, 12, 63, 64)]
    strings = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["".join(rng.choice("abc") for _ in range(70)), words[-1], words[-1][1:]]
    scanner = Scanner(words)
    codes, lengths = scanner.strings(strings)
    pairs = [(w, s) for w in range(len(words)) for s in range(len(strings))]
    whole, prefix = scanner.distances(*(np.array(x) for x in zip(*pairs)), codes, lengths)
    assert whole.tolist() == [_osa(words[w], strings[s]) for w, s in pairs]
    short = [i for i, (_, s) in enumerate(pairs) if len(strings[s]) < 20]
    assert prefix[short].tolist() == [min(_osa(words[pairs[i][0]], strings[pairs[i][1]][:n]) for n in range(len(strings[pairs[i][1]]) + 1)) for i in short]


def test_near_strings_share_a_deletion(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: [set(r.d1), set(r.d2)] for r in df.select("w", deletions(F.col("w"), 1).alias("d1"), deletions(F.col("w"), F.lit(2)).alias("d2")).collect()}
    for a in words:
        for b in words:
            for k in (1, 2):
                assert _osa(a, b) > k or got[a][k - 1] & got[b][k - 1]


def test_clean_values(spark):
    df = spark.createDataFrame([([" Noir", "noir\t", "", None, "\xa0 ", "Spy"],), (None,), ([],)], "g array<string>")
    assert [r.v for r in df.select(clean_values(F.col("g")).alias("v")).collect()] == [["noir", "spy"], [], []]


def test_documents_without_tokens_are_counted(spark, tmp_path):
    from plumbline.queries import token_counts_documents

    rows = [(1, "The sea, the sea"), (2, None), (3, ""), (4, "--- !"), (5, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in token_counts_documents(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 4, 2), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1)]
