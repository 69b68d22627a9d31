"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, social security numbers,
phone numbers and calendar dates are validated and then permuted under a key
within their format; e-mail names and secrets are permuted within the character
classes of each place. Each permutation is a Feistel network, so it is one to
one: equal values stay equal and different ones different, in all documents.
What does not validate stays as it is.

Defined results: a null text stays null, an empty one empty, both with no
matches; every row is treated alone, so repeated rows and null ids need no
rule; `pseudonymise` keeps all further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For the query, tests and the pipeline where no key is set. Whoever knows the key can undo the pseudonyms, and this one is public.
DEMO_KEY = "strandlake-demo-key"

#: The length of an IBAN by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As long as the country's numbers are, so that a word behind is left out; any length where that does not match."""
    by_length = (rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join(by_length)}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind and pattern; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "aws": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|secret|token|api_?key)[\"']? ?[=:] ?[\"']?(?=[^\s,;\"']*\d)[^\s,;\"']{6,}",
    "iban": _iban_pattern(),
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{2,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\2\d{4})(?!\w|[/-]|\.\d)",
}
KINDS = tuple(PATTERNS)
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days from 1900-01-01 to 2099-12-31 are 17 x 4297; social security numbers 898 x (99 x 9999).
DAYS, SSNS, ADDRESSES = (17, 4297), (898, 99 * 9999), (1 << 16, 1 << 16)


def _draw(key: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), step.cast("string"), other.cast("string")), 256)


def permute_number(value: Column, halves: tuple[int, int], key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. halves[0] * halves[1] - 1: the halves are shifted in turn."""
    a, b = halves
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("a"), F.pmod(value, F.lit(b)).cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        draw = lambda x: F.conv(F.substring(_draw(key, i, x), 1, 12), 16, 10).cast("long")
        return F.when(i % 2 == 0, F.struct(F.pmod(acc["a"] + draw(acc["b"]), F.lit(a)).cast("long").alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + draw(acc["a"]), F.lit(b)).cast("long").alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["a"] * b + acc["b"])


def _shifted(text: Column, draw: Column) -> Column:
    """Each letter or digit moves on within its class by a byte of the draw; others stay."""

    def one(ch: Column, i: Column) -> Column:
        c = F.ascii(ch)
        by = F.conv(F.substr(draw, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        move = lambda low, n: F.chr(F.lit(low) + F.pmod(c - low + by, F.lit(n)))
        return F.when(c.between(48, 57), move(48, 10)).when(c.between(97, 122), move(97, 26)).when(c.between(65, 90), move(65, 26)).otherwise(ch)

    return F.array_join(F.transform(F.split(text, "", -1), one), "")


def permute_text(value: Column, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings with the same length and classes of characters."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"), F.lit("").alias("d"))

    def step(acc: Column, i: Column) -> Column:  # draw in even steps, shift and swap in odd ones
        return F.when(i % 2 == 0, F.struct(acc["l"].alias("l"), acc["r"].alias("r"), _draw(key, i, acc["r"]).alias("d"))).otherwise(F.struct(acc["r"].alias("l"), _shifted(acc["l"], acc["d"]).alias("r"), F.lit("").alias("d")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(form: Column, digits: Column) -> Column:
    """The digits in the places of the form's digits, in order."""

    def one(acc: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substr(digits, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], ch).alias("s"), acc["n"].alias("n")))

    return F.aggregate(F.split(form, "", -1), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), one, lambda acc: acc["s"])


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (0 if double_last else 1)
        return acc + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, False) % 10 == 0


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key))
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn_sum(b, True), F.lit(10)).cast("string")))[0]
    return F.when(luhn_valid(d), refill(m, full)).otherwise(m)


def _mod97(text: Column) -> Column:
    def add(acc: Column, ch: Column) -> Column:
        c = F.ascii(ch)
        return F.when(c.between(48, 57), (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.split(text, "", -1), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(add(acc, ch)))


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    country, rest = F.substr(s, F.lit(1), F.lit(2)), permute_text(F.substr(s, F.lit(5), F.length(s)), key)
    full = F.transform(F.array(rest), lambda r: F.concat(country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))[0]

    def place(acc: Column, ch: Column) -> Column:
        return F.when(ch == " ", F.struct(F.concat(acc["s"], ch).alias("s"), acc["n"].alias("n"))).otherwise(F.struct(F.concat(acc["s"], F.substr(full, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n")))

    spaced = F.aggregate(F.split(m, "", -1), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), place, lambda acc: acc["s"])
    return F.when(_mod97(turned) == 1, spaced).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = digits_of(m)
    keep = F.when(m.startswith("+1"), 1).when(m.startswith("+"), 2).otherwise(0)
    new = F.concat(F.substr(d, F.lit(1), keep), permute_text(F.substr(d, keep + 1, F.length(d)), key))
    return F.when(F.length(d).between(7, 15), refill(m, new)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    v = permute_number(o[0] * (1 << 24) + o[1] * (1 << 16) + o[2] * 256 + o[3], ADDRESSES, key)
    return F.transform(F.array(v), lambda n: F.concat_ws(".", *(F.pmod(F.floor(n / F.lit(1 << s)).cast("long"), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))[0]


def _ssn(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = p[0] - 1 - F.when(p[0] > 666, 1).otherwise(0)
    v = permute_number((area * 99 + p[1] - 1) * 9999 + p[2] - 1, SSNS, key)

    def form(n: Column) -> Column:
        a = F.floor(n / F.lit(99 * 9999)).cast("long") + 1
        b, c = F.pmod(F.floor(n / F.lit(9999)).cast("long"), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(b.cast("string"), 2, "0"), F.lpad(c.cast("string"), 4, "0"))

    return F.transform(F.array(v), form)[0]


def _date(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    iso, dots = m.contains("-"), m.contains(".")
    year = F.when(iso, p[0]).otherwise(p[2])
    month_first = ~dots & (p[0] <= 12)  # 12/31/1999, and 31/12/1999 where that is no month
    month = F.when(iso, p[1]).when(month_first, p[0]).otherwise(p[1])
    day = F.when(iso, p[2]).when(month_first, p[1]).otherwise(p[0])
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = year.between(1900, 2099) & month.between(1, 12) & (day >= 1) & (day <= last)
    origin = F.lit("1900-01-01").cast("date")
    n = permute_number(F.datediff(F.make_date(year, month, day), origin).cast("long"), DAYS, key)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def form(x: Column) -> Column:
        d = F.date_add(origin, x.cast("int"))
        dm = F.when(dots, F.concat_ws(".", two(F.dayofmonth(d)), two(F.month(d)))).when(month_first, F.concat_ws("/", two(F.month(d)), two(F.dayofmonth(d)))).otherwise(F.concat_ws("/", two(F.dayofmonth(d)), two(F.month(d))))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(dm, F.when(dots, F.lit(".")).otherwise(F.lit("/")), F.year(d).cast("string")))

    return F.when(valid, F.transform(F.array(n), form)[0]).otherwise(m)


def _tail(m: Column, key: str, prefix: str) -> Column:
    head = F.regexp_extract(m, prefix, 0)
    return F.concat(head, permute_text(F.substr(m, F.length(head) + 1, F.length(m)), key))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_text(name, key), F.substr(m, F.length(name) + 1, F.length(m)))


def _kind(m: Column) -> Column:
    whole = {k: rf"^(?:{p})$" for k, p in PATTERNS.items()}
    out = F.lit("none")
    for k in reversed(KINDS):
        out = F.when(m.rlike(whole[k].replace(r"\2", r"\1")), k).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "aws", _tail(m, key, "^AKIA")).when(kind == "secret", _tail(m, key, r"^[A-Za-z_]+[\"']? ?[=:] ?[\"']?"))
        .when(kind == "iban", _iban(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "card", _card(m, key))
        .when(kind == "ssn", _ssn(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).otherwise(m)
    )


def _substitutes(text: Column, key: str) -> Column:
    found = F.when(text.rlike("[0-9@]|AKIA"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda m: F.struct(m.alias("old"), _kind(m).alias("kind")))
    return F.transform(kinds, lambda s: F.struct(s["old"].alias("old"), s["kind"].alias("kind"), pseudonym(s["old"], s["kind"], key).alias("new")))


def secret_key(spark, default: str | None = None) -> str:
    """The key in spark.strandlake.pii.key, or else `default`; ValueError where there is neither."""
    key = spark.conf.get("spark.strandlake.pii.key", default)
    if not key:
        raise ValueError("set spark.strandlake.pii.key or give a key")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", found_col: str = "_pii_found") -> DataFrame:
    """docs with the text rewritten, and behind its columns what was matched: array of (old, kind, new).

    That column is called found_col, with underscores behind it where docs has such a column.
    Without a key the session's is taken (`secret_key`).
    """
    key = key or secret_key(docs.sparkSession)
    while found_col in docs.columns:
        found_col += "_"
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    marked = inner.withColumn("_found", F.when(F.col("_text").isNull(), F.array().cast("array<struct<old:string,kind:string,new:string>>")).otherwise(_substitutes(F.col("_text"), key)))
    new = F.concat(F.transform("_found", lambda s: s["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(F.split("_text", PATTERN, -1), new, lambda a, b: F.concat(a, b)), "")
    text = F.when(F.size("_found") > 0, rebuilt).otherwise(F.col("_text"))
    return marked.select(*(text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns), F.col("_found").alias(found_col))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the text rewritten and n_chars, where there is such a column, counted again."""
    found = pseudonymise(docs, key)
    out = found.drop(found.columns[-1])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), secret_key(spark, DEMO_KEY))
    changed = F.filter("_pii_found", lambda s: s["old"] != s["new"])
    of = F.transform(changed, lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.size(changed).cast("long").alias("n_replaced"), *counts)
