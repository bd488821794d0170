import datetime
import re

import pytest
from pyspark.sql import functions as F

from visitlake.llm.pseudonyms import ANY, feistel, pseudonymise

SAMPLES = {
    "card": ["4532015112830366", "4532-0151-1283-0366", "4532 0151 1283 0366", "378282246310005"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0100", "+44 (020) 794-6095"],
    "ssn": ["123-45-6789"], "ip": ["97.51.17.173", "0.0.0.0"], "date": ["2024-02-29", "31.12.1999", "01/02/2003"], "email": ["und.34@mail7.example.com"],
}
LEFT_ALONE = ["4532015112830367", "999.1.1.1", "000-12-3456", "666-12-3456", "2023-02-29", "31.02.1999", "1.2.3.4.5", "12345678901234567890", "v2.0", "a@b", "2200-01-01"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def texts(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text for r in pseudonymise(df, "secret", **kw).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("left", "right"), [(17, 4_297), (3, 5), (1, 7), (1_000, 1_000)])
def test_feistel_is_a_permutation(spark, left, right):
    n = left * right
    rows = spark.range(min(n, 80_000) if n < 100_000 else 50_000)
    new = rows.select("id", feistel(F.col("id"), F.lit(left).cast("bigint"), F.lit(right).cast("bigint"), "k", "t").alias("new"))
    back = new.select("id", "new", feistel(F.col("new"), F.lit(left).cast("bigint"), F.lit(right).cast("bigint"), "k", "t", back=True).alias("old"))
    count, distinct, low, high, same = back.agg(F.count("*"), F.countDistinct("new"), F.min("new"), F.max("new"), F.sum((F.col("id") == F.col("old")).cast("int"))).first()
    assert count == distinct == same and low >= 0 and high < n


def test_formats_validity_and_way_back(spark):
    values = [v for kind in SAMPLES for v in SAMPLES[kind]]
    new = texts(spark, values)
    for kind, old, got in zip([k for k in SAMPLES for _ in SAMPLES[k]], values, new):
        if kind == "email":
            assert re.fullmatch(r"user-[0-9a-f]{16}@pseudonym\.invalid", got)
            continue
        assert got != old
        if kind == "ip":
            assert all(0 <= int(p) <= 255 for p in got.split("."))
            continue
        assert re.sub(r"\d", "9", got) == re.sub(r"\d", "9", old)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", got))
        if kind == "date":
            form = "%Y-%m-%d" if old[4] == "-" else f"%d{old[2]}%m{old[2]}%Y"
            assert 1900 <= datetime.datetime.strptime(got, form).year <= 2099
    assert re.sub(r"\D", "", new[0]) == re.sub(r"\D", "", new[1]) == re.sub(r"\D", "", new[2])  # the same number, however written
    assert texts(spark, new, back=True)[:-1] == values[:-1]
    other = spark.createDataFrame([(0, values[0])], "doc_id long, text string")
    assert pseudonymise(other, "another secret").first().text != new[0]


def test_invalid_values_stay(spark):
    assert texts(spark, LEFT_ALONE) == LEFT_ALONE


def test_spans_and_odd_rows(spark, odd_docs, no_docs, clashing):
    text = "é " + " and ".join(v for k in SAMPLES for v in SAMPLES[k]) + " or " + " , ".join(LEFT_ALONE[:8]) + "."
    row = pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "secret").first()
    assert len(row.pii) == sum(map(len, SAMPLES.values()))
    assert all(row.text[p.start:p.start + len(p.pseudonym)] == p.pseudonym for p in row.pii)
    gaps = re.split(ANY, text)[:0]  # the pattern is valid for other engines too
    assert gaps == [] and not any(v in row.text for k in SAMPLES for v in SAMPLES[k])
    out = pseudonymise(clashing, "secret")
    assert out.columns == clashing.columns and out.count() == odd_docs.count()
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd_docs.collect())
    assert pseudonymise(no_docs, "secret").count() == 0
    long_text = "4532015112830366 " * 3_000
    assert len(texts(spark, [long_text])[0]) == len(long_text)


MORE = {"phone": ["243-555-5526", "243.555.5526", "+12435555526", "(243)5555526", "+44 20 7946 0958"], "card": ["3782 822463 10005", "3782-822463-10005"],
        "date": ["1/2/2024", "2024-1-5", "9.11.2001"]}


def test_more_formats_are_found_and_keep_their_shape(spark):
    values = [v for kind in MORE for v in MORE[kind]]
    new = texts(spark, [f"call {v}, or so" for v in values])
    for kind, old, got in zip([k for k in MORE for _ in MORE[k]], values, new):
        got = re.fullmatch("call (.*), or so", got).group(1)
        assert got != old
        if kind == "date":
            assert re.sub(r"\d+", "9", got) == re.sub(r"\d+", "9", old)
            continue
        assert re.sub(r"\d", "9", got) == re.sub(r"\d", "9", old)
        assert kind != "card" or luhn(re.sub(r"\D", "", got))
    back = texts(spark, new, back=True)
    assert back[:7] == [f"call {v}, or so" for v in values[:7]]
    assert texts(spark, ["+12435555526", "+1 (243) 555-5526"])[0][2:] == re.sub(r"\D", "", texts(spark, ["+1 (243) 555-5526"])[0])[1:]
    kept = ["1234-567-8901", "12-345-6789", "1.2.3", "123.456.78901", "2024-13-5", "32/1/2024", "+123456", "3782 822463 10006"]
    assert texts(spark, kept) == kept


def plain_feistel(number, left, right, kind, secret="secret"):
    """The permutation in Python's whole numbers."""
    import hashlib

    a, b = divmod(number, right)
    for i in range(8):
        half = b if i % 2 == 0 else a
        noise = int(hashlib.sha256(f"{secret}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + noise % left) % left
        else:
            b = (b + noise % right) % right
    return a * right + b


def test_pseudonyms_equal_a_plain_permutation(spark):
    phones = [f"({a}) 555-{b:04d}" for a, b in ((212, 100), (987, 6543), (200, 0), (999, 9999))]
    got = texts(spark, phones)
    for old, new in zip(phones, got):
        digits = re.sub(r"\D", "", old)
        assert int(re.sub(r"\D", "", new)) == plain_feistel(int(digits), 10 ** 5, 10 ** 5, "phone")
    cards = ["4532015112830366", "378282246310005"]
    for old, new in zip(cards, texts(spark, cards)):
        n = len(old) - 1
        payload = f"{plain_feistel(int(old[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), 'card'):0{n}d}"
        assert new[:-1] == payload and luhn(new)
    days = ["2024-02-29", "1900-01-01", "2099-12-31"]
    first = datetime.date(1900, 1, 1)
    want = [first + datetime.timedelta(plain_feistel((datetime.date.fromisoformat(d) - first).days, 17, 4_297, "date")) for d in days]
    assert texts(spark, days) == [w.isoformat() for w in want]
    addresses = ["97.51.17.173", "0.0.0.0"]
    numbers = [plain_feistel(sum(int(p) << s for p, s in zip(x.split("."), (24, 16, 8, 0))), 65_536, 65_536, "ip") for x in addresses]
    assert texts(spark, addresses) == [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers]
