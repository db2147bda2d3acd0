"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are whole runs of digits, letters and separators, found by one pattern, and each is validated as a whole, so nothing is cut out of a longer number: payment
cards by Luhn's sum, addresses by their octets, dates by the calendar, social security numbers by their ranges, bank accounts by their remainder. A valid value is numbered within its format's
domain and permuted by an alternating Feistel network keyed with SHA-256, then written in the same format: a card keeps its length, separators and a valid check
digit, a date stays a date. Equal values get equal pseudonyms in every document, and different values of one format different ones, without any shared table. E-mail addresses,
IPv6 addresses and secrets have no numbered domain; they get keyed digests of their own form.

Dates from 1900 to 2099 are permuted among themselves and the calendar's other days, from year 1 to 9999, among each other. A date written with
the day first stays one.

Rows are rewritten where they are: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

ROUNDS = 8



def pattern(repeated: str = "++") -> str:
    """What may be personal data; the first alternative that fits counts. No look-around, so that other engines read it alike: runs are taken whole instead.

    ``repeated``: how unbounded groups repeat. Each of them takes all that it can, and nothing shorter would fit better; so they never give back, which spares
    Java's matcher a call on its stack for each repetition. Engines that don't know ``++`` find the same by ``+``.
    """
    return (
        r"[\pL0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})@@"
        r"|\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]+"
        r"|\+[0-9]{4,}|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-][0-9]+){1,5}"
        r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]+"
        r"|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]+|[0-9]{4} [0-9]{6} [0-9]+"
        r"|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"
        r"|[0-9A-Fa-f]{1,4}(?::|:[0-9A-Fa-f]{1,4})(?::+[0-9A-Fa-f]{1,4})@@[0-9A-Fa-f]*"
        r"|(?:sk|pk|rk)[-_](?:live_|test_|proj-)?[A-Za-z0-9]{20,}|gh[oprsu]_[A-Za-z0-9]{30,}|xox[abp]-[0-9]{8,}-[0-9A-Za-z-]{16,}"
        r"|[0-9]+(?:-[0-9]+)@@|[0-9]+(?:\.[0-9]+)@@|[0-9]+(?:/[0-9]+)@@"
        r"|[A-Za-z0-9]{15,}"
        r"|[0-9]+"
    ).replace("@@", repeated)


PATTERN = pattern()
#: Days of the years 1900 to 2099 and of all others from 1 to 9999, as products for the network.
MODERN, OTHER = (17, 4297), (1258, 2845)
FIRST_DAY, FIRST_MODERN = "0001-01-01", 693_595

KINDS = ("email", "phone", "card", "iban", "ip", "ip6", "date", "ssn", "secret")
#: Kinds whose pseudonyms are permutations of a string of digits.
DIGIT_KINDS = ("phone", "card", "iban")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def digit_at(text: Column, place: Column) -> Column:
    return F.substr(text, place, F.lit(1)).cast("int")


def luhn(number: Column, doubled_first: bool) -> Column:
    """Luhn's sum of a digit string, from the right; ``doubled_first``: the last digit counts twice (as before a check digit)."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = digit_at(number, n - i)
        double = d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(i % 2 == (0 if doubled_first else 1), double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def mod97(account: Column) -> Column:
    """Remainder of an account number (country, check digits, account), rotated by four characters and with letters as 10 ... 35."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(total: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, total * 10 + c - 48).otherwise(total * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step)


def permuted(start: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """A keyed permutation of pairs (l, r) below (a, b): each round adds a digest of one part to the other, modulo its size."""

    def mixed(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, (s["l"] + mixed(i, s["r"]) % a) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, (s["r"] + mixed(i, s["l"]) % b) % b).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_number(value: Column, a: Column | int, b: Column | int, kind: str, key: str) -> Column:
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))
    start = F.struct(((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))
    return let(permuted(start, a, b, kind, key), lambda s: s["l"] * b + s["r"])


def permuted_digits(number: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the digit strings of one length, 2 to 36, as two halves."""
    n = F.length(number)
    small = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(number, F.lit(1), n - small).cast("long").alias("l"), F.substr(number, n - small + 1, small).cast("long").alias("r"))
    zeros = lambda x, size: F.lpad(x.cast("string"), size, F.lit("0"))
    return let(permuted(start, power_of_ten(n - small), power_of_ten(small), kind, key), lambda s: F.concat(zeros(s["l"], n - small), zeros(s["r"], small)))


def let(value: Column, use) -> Column:
    """``use(value)``, worked out once, also where lambdas in ``use`` refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def power_of_ten(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def relaid(x: Column, plain: Column, marks: str) -> Column:
    """``x`` with its characters replaced in turn by those of ``plain``, but for those that fit ``marks``."""

    def one(d: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substr(x, F.lit(1), i), marks, ""))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substr(x, i, F.lit(1)).rlike(marks), F.substr(x, i, F.lit(1))).otherwise(F.substr(d, place(i), F.lit(1)))), "")

    return let(plain, one)


def date_order(x: Column) -> Column:
    """How a date is written: ymd, mdy or dmy; null where it isn't like one. Slashes mean the month first where it can be."""
    return (
        F.when(x.rlike("^[0-9]{4}(-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}$"), "ymd")
        .when(x.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & (F.substring(x, 1, 2) <= "12"), "mdy")
        .when(x.rlike(r"^[0-9]{2}(-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}$"), "dmy")
    )


def day_of(x: Column) -> Column:
    """Days since ``FIRST_DAY`` of a date; null where it isn't one of the calendar."""
    order = date_order(x)
    part = lambda *at: F.substring(x, *at)
    iso = F.when(order == "ymd", F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2))).when(order == "mdy", F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))).when(order == "dmy", F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when(day >= 0, day)


def dated(x: Column, day: Column) -> Column:
    """The day written as ``x`` is."""

    def written(d: Column) -> Column:
        y, m, t = F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")
        order = date_order(x)
        mark = F.when(order == "ymd", F.substring(x, 5, 1)).otherwise(F.substring(x, 3, 1))
        return F.when(order == "ymd", F.concat(y, mark, m, mark, t)).when(order == "mdy", F.concat(m, mark, t, mark, y)).otherwise(F.concat(t, mark, m, mark, y))

    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), written)


def kind_of(x: Column) -> Column:
    """Which validated kind a candidate is; null for all others. The whole candidate counts."""
    number = digits(x)
    area, group, serial = (F.substring(x, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    octets = F.split(x, r"\.")
    groups = F.split(x, ":")
    filled = F.size(F.filter(groups, lambda g: F.length(g) > 0))
    account = F.replace(x, F.lit(" "), F.lit(""))
    return (
        F.when(x.contains("@"), "email")
        .when(x.startswith("+"), F.when(F.length(number).between(9, 15), "phone"))
        .when(x.contains("("), F.when(x.rlike(r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$"), "phone"))
        .when(x.rlike(r"^((1-)?[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})$"), "phone")
        .when(
            x.contains(":"),
            F.when(F.forall(groups, lambda g: F.length(g) <= 4) & (((F.size(groups) == 8) & (filled == 8)) | ((F.size(groups) <= 8) & (filled >= 3) & (F.size(groups) == filled + 1))), "ip6"),
        )
        .when(x.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.when(F.forall(octets, lambda o: (F.length(o) <= 3) & (o.try_cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0"))), "ip"))
        .when(date_order(x).isNotNull(), F.when(day_of(x).isNotNull(), "date"))
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), "ssn"))
        .when(x.rlike(r"^([0-9]{13,19}|[0-9]{4}( [0-9]{4}){3}|[0-9]{4}(-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})$"), F.when(luhn(number, False) % 10 == 0, "card"))
        .when(account.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.length(number) >= 8) & (mod97(account) == 1), "iban")
        .when(x.rlike("^[0-9A-Fa-f]{32,128}$") & x.rlike("[A-Fa-f]") & x.rlike("[0-9]"), "secret")
        .when(x.rlike("^(sk|pk|rk|gh[oprsu]|xox[abp])[-_]") & (F.length(number) >= 2), "secret")
        .when(x.rlike("^AKIA[0-9A-Z]{16}$") | (x.rlike("^[A-Za-z0-9]{32,256}$") & x.rlike("[a-z]") & x.rlike("[A-Z]") & (F.length(number) >= 4)), "secret")
    )


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    number = digits(x)
    n = F.length(number)
    not_digit = "[^0-9]"
    card = let(permuted_digits(F.substr(number, F.lit(1), n - 1), "card", key), lambda c: F.concat(c, ((10 - luhn(c, True) % 10) % 10).cast("string")))
    kept = country_digits(x)
    phone = F.concat(F.substr(number, F.lit(1), kept), permuted_digits(F.substr(number, kept + 1, n - kept), "phone", key))
    account = F.replace(x, F.lit(" "), F.lit(""))

    def checked(d: Column) -> Column:
        blank = F.concat(F.substring(account, 1, 2), F.lit("00"), F.substr(relaid(account, F.concat(F.lit("00"), d), not_digit), F.lit(5), F.length(account)))
        return F.concat(F.lpad((98 - mod97(blank)).cast("string"), 2, "0"), d)

    iban = let(permuted_digits(F.substr(number, F.lit(3), n - 2), "iban", key), checked)
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    ip = let(permuted_number(whole, 65_536, 65_536, "ip", key), lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))

    def moved(day: Column) -> Column:
        modern = day.between(FIRST_MODERN, FIRST_MODERN + MODERN[0] * MODERN[1] - 1)
        size = MODERN[0] * MODERN[1]
        index = F.when(modern, day - FIRST_MODERN).when(day < FIRST_MODERN, day).otherwise(day - size)
        a, b = (F.when(modern, F.lit(m)).otherwise(F.lit(o)) for m, o in zip(MODERN, OTHER))
        return let(permuted_number(index, a, b, "date", key), lambda v: F.when(modern, v + FIRST_MODERN).when(v < FIRST_MODERN, v).otherwise(v + size))

    date = dated(x, let(day_of(x).cast("long"), moved))
    area = F.substring(x, 1, 3).cast("long")
    place = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(x, 5, 2).cast("long") - 1) * 9999 + F.substring(x, 8, 4).cast("long") - 1

    def ssn_of(v: Column) -> Column:
        index = ((v - v % 989_901) / 989_901).cast("long")
        area = F.when(index + 1 >= 666, index + 2).otherwise(index + 1)
        group, serial = ((v % 989_901 - v % 9999) / 9999).cast("long") + 1, v % 9999 + 1
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))

    ssn = let(permuted_number(place, 88_902, 9_999, "ssn", key), ssn_of)
    folded = F.when((kind == "secret") & ~x.rlike("^[0-9A-Fa-f]+$"), x).otherwise(F.lower(x))
    digest = F.sha2(F.concat(F.lit(f"{key}|text|"), folded), 256)
    email = let(digest, lambda d: F.concat(F.lit("user-"), F.substring(d, 1, 12), F.lit("@"), F.substring(d, 13, 8), F.lit(".invalid")))
    prefix = F.regexp_extract(x, "^((sk|pk|rk|gh[oprsu]|xox[abp])[-_]).", 1)
    hidden = F.substr(F.repeat(digest, F.lit(4)), F.lit(1), F.length(x) - F.length(prefix))
    secret = F.concat(prefix, F.when((F.upper(x) == x) | (x.rlike("^[0-9A-Fa-f]+$") & (F.lower(x) != x)), F.upper(hidden)).otherwise(hidden))
    return (
        F.when(kind == "email", email).when(kind == "phone", relaid(x, phone, not_digit)).when(kind == "card", relaid(x, card, not_digit)).when(kind == "iban", relaid(x, iban, not_digit))
        .when(kind == "ip", ip).when(kind == "ip6", relaid(x, digest, ":")).when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "secret", secret).otherwise(x)
    )


def country_digits(x: Column) -> Column:
    """Leading digits of a phone number that stay: those before the first separator of an international one, 1 or two of them where it has none."""
    code = F.regexp_extract(x, r"^\+([0-9]{1,3})[ .(-]", 1)
    return F.when(F.length(code) > 0, F.length(code)).when(x.startswith("+1") | x.startswith("1-"), 1).when(x.startswith("+"), 2).otherwise(0)


def counted(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda m: m["kind"] == kind))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with validated personal data replaced in ``text``; ``n_<kind>`` counts what was replaced.

    Null texts stay null with counts of 0; empty texts stay empty. Repeated rows and values are treated alike. Further columns stay as they are, whatever their names, but for
    the counts, which are replaced. An empty table gives no rows. Whole texts are rewritten, whatever their length. The key decides all
    pseudonyms; keep it secret, and equal wherever documents are to stay linked.
    """
    text = F.col("text")
    (name,) = free(docs, "found")
    candidates = F.when(text.rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.transform(candidates, lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))
    new = F.transform(name, lambda m: pseudonym(m["x"], m["kind"], key))
    rebuilt = F.array_join(F.zip_with(F.split("text", PATTERN, -1), F.concat(new, F.array(F.lit(""))), lambda s, m: F.concat(s, m)), "")
    out = docs.drop(*[f"n_{k}" for k in KINDS]).withColumn(name, found)
    for kind in KINDS:
        out = out.withColumn(f"n_{kind}", F.coalesce(counted(name, kind), F.lit(0)))
    any_found = F.exists(name, lambda m: m["kind"].isNotNull())
    return out.withColumn("text", F.when(any_found, rebuilt).otherwise(text)).drop(name)


def oracle(key: str) -> str:
    """The query's rows in SQL: candidates as rows, a step of the permutation a subquery."""
    luhn_sum = (
        "list_sum(list_transform(range(0, len({d})), lambda i: case when i % 2 = {odd} then cast({d}[len({d}) - i] as int) * 2"
        " - case when cast({d}[len({d}) - i] as int) > 4 then 9 else 0 end else cast({d}[len({d}) - i] as int) end))"
    )
    code = "case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end"
    mod97_of = f"list_reduce(list_transform(string_split({{z}}[5:] || {{z}}[1:4], ''), lambda c: cast({code} as bigint)), lambda s, v: case when v < 10 then (s * 10 + v) % 97 else (s * 100 + v) % 97 end, cast(0 as bigint))"
    laid = "array_to_string(list_transform(range(1, len({x}) + 1), lambda i: case when regexp_matches({x}[i], '{marks}') then {x}[i] else {d}[len(regexp_replace({x}[1:i], '{marks}', '', 'g'))] end), '')"
    steps = []
    for i in range(ROUNDS):
        x = "r" if i % 2 == 0 else "l"
        mixed = f"cast('0x' || sha256('{key}|' || kind || '|{i}|' || {x})[1:15] as bigint)"
        l, r = ("(l + " + mixed + " % a) % a", "r") if i % 2 == 0 else ("l", "(r + " + mixed + " % b) % b")
        steps.append(f"f{i + 1} as (select * replace ({l} as l, {r} as r) from f{i})")
    ten = lambda n: f"cast('1' || repeat('0', {n}) as bigint)"
    own = pattern("+").replace("'", "''")
    kinds = ", ".join(f"'{k}'" for k in DIGIT_KINDS)
    size = MODERN[0] * MODERN[1]
    hexadecimal = "regexp_full_match(x, '[0-9A-Fa-f]+')"
    secret_prefix = "(sk|pk|rk|gh[oprsu]|xox[abp])[-_]"
    return f"""
with t as (
  select doc_id, text, regexp_extract_all(text, '{own}') as ms, regexp_split_to_array(text, '{own}') as segs from documents where regexp_matches(text, '[0-9@]')
), m0 as (
  select doc_id, i, ms[i] as x, regexp_replace(ms[i], '[^0-9]', '', 'g') as d, replace(ms[i], ' ', '') as acc,
    case when regexp_full_match(ms[i], '[0-9]{{4}}(-[0-9]{{2}}-|/[0-9]{{2}}/)[0-9]{{2}}') then 'ymd'
      when regexp_full_match(ms[i], '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') and ms[i][1:2] <= '12' then 'mdy'
      when regexp_full_match(ms[i], '[0-9]{{2}}(-[0-9]{{2}}-|/[0-9]{{2}}/|\\.[0-9]{{2}}\\.)[0-9]{{4}}') then 'dmy' end as ord
  from t, unnest(range(1, len(ms) + 1)) u(i)
), m as (
  select *, try_cast(case ord when 'ymd' then x[1:4] || '-' || x[6:7] || '-' || x[9:10] when 'mdy' then x[7:10] || '-' || x[1:2] || '-' || x[4:5]
    when 'dmy' then x[7:10] || '-' || x[4:5] || '-' || x[1:2] end as date) - date '{FIRST_DAY}' as day,
    len(list_filter(string_split(x, ':'), lambda g: len(g) > 0)) as filled, len(string_split(x, ':')) as n_groups from m0
), k as (
  select *, case when contains(x, '@') then 'email'
    when x[1] = '+' then case when len(d) between 9 and 15 then 'phone' end
    when contains(x, '(') then case when regexp_full_match(x, '\\([0-9]{{3}}\\) ?[0-9]{{3}}-[0-9]{{4}}') then 'phone' end
    when regexp_full_match(x, '(1-)?[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}\\.[0-9]{{3}}\\.[0-9]{{4}}') then 'phone'
    when contains(x, ':') then case when len(list_filter(string_split(x, ':'), lambda g: len(g) > 4)) = 0 and ((n_groups = 8 and filled = 8) or (n_groups <= 8 and filled >= 3 and n_groups = filled + 1)) then 'ip6' end
    when regexp_full_match(x, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') then
      case when len(list_filter(string_split(x, '.'), lambda o: len(o) > 3 or try_cast(o as int) > 255 or (len(o) > 1 and o[1] = '0'))) = 0 then 'ip' end
    when ord is not null then case when day >= 0 then 'date' end
    when regexp_full_match(x, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') then
      case when cast(x[1:3] as int) not in (0, 666) and cast(x[1:3] as int) < 900 and x[5:6] <> '00' and x[8:11] <> '0000' then 'ssn' end
    when regexp_full_match(x, '[0-9]{{13,19}}|[0-9]{{4}}( [0-9]{{4}}){{3}}|[0-9]{{4}}(-[0-9]{{4}}){{3}}|[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}}') then
      case when {luhn_sum.format(d="d", odd=1)} % 10 = 0 then 'card' end
    when regexp_full_match(acc, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') and len(d) >= 8 and {mod97_of.format(z="acc")} = 1 then 'iban'
    when regexp_full_match(x, '[0-9A-Fa-f]{{32,128}}') and regexp_matches(x, '[A-Fa-f]') and regexp_matches(x, '[0-9]') then 'secret'
    when regexp_matches(x, '^{secret_prefix}') and len(d) >= 2 then 'secret'
    when regexp_full_match(x, 'AKIA[0-9A-Z]{{16}}') or (regexp_full_match(x, '[A-Za-z0-9]{{32,256}}') and regexp_matches(x, '[a-z]') and regexp_matches(x, '[A-Z]') and len(d) >= 4) then 'secret' end as kind,
    case when regexp_matches(x, '^\\+[0-9]{{1,3}}[ .(-]') then len(regexp_extract(x, '^\\+([0-9]{{1,3}})[ .(-]', 1)) when x[1:2] in ('+1', '1-') then 1 when x[1] = '+' then 2 else 0 end as code
  from m
), v0 as (
  select *, case kind when 'card' then d[1 : len(d) - 1] when 'phone' then d[code + 1 : len(d)] when 'iban' then d[3 : len(d)] else '00' end as p,
    case when kind = 'date' and day between {FIRST_MODERN} and {FIRST_MODERN + size - 1} then 1 else 0 end as modern from k
), v as (
  select *, case kind when 'ip' then list_reduce(list_transform(string_split(x, '.'), lambda o: cast(o as bigint)), lambda s, o: s * 256 + o)
      when 'date' then cast(case when modern = 1 then day - {FIRST_MODERN} when day < {FIRST_MODERN} then day else day - {size} end as bigint)
      when 'ssn' then ((cast(x[1:3] as bigint) - case when cast(x[1:3] as int) > 666 then 2 else 1 end) * 99 + cast(x[5:6] as bigint) - 1) * 9999 + cast(x[8:11] as bigint) - 1
      else 0 end as v,
    case when kind in ({kinds}) then {ten("len(p) - len(p) // 2")} when kind = 'ip' then 65536 when modern = 1 then {MODERN[0]} when kind = 'date' then {OTHER[0]} when kind = 'ssn' then 88902 else 1 end as a,
    case when kind in ({kinds}) then {ten("len(p) // 2")} when kind = 'ip' then 65536 when modern = 1 then {MODERN[1]} when kind = 'date' then {OTHER[1]} when kind = 'ssn' then 9999 else 1 end as b
  from v0
), f0 as (
  select *, case when kind in ({kinds}) then cast(p[1 : len(p) - len(p) // 2] as bigint) else v // b end as l, case when kind in ({kinds}) then cast(p[len(p) - len(p) // 2 + 1 : len(p)] as bigint) else v % b end as r from v
), {", ".join(steps)}, g as (
  select *, cast(case when kind in ({kinds}) then 0 else l * b + r end as bigint) as w,
    case when kind in ({kinds}) then lpad(cast(l as varchar), cast(len(p) - len(p) // 2 as integer), '0') || lpad(cast(r as varchar), cast(len(p) // 2 as integer), '0') else '' end as pn,
    sha256('{key}|text|' || case when kind = 'secret' and not {hexadecimal} then x else lower(x) end) as h,
    case when kind = 'secret' then regexp_extract(x, '^({secret_prefix}).', 1) else '' end as pre from f{ROUNDS}
), c0 as (
  select *, case when kind = 'iban' then acc[1:2] || '00' || ({laid.format(x="acc", d="('00' || pn)", marks="[^0-9]")})[5:] end as blank,
    date '{FIRST_DAY}' + cast(case when kind = 'date' then case when modern = 1 then w + {FIRST_MODERN} when w < {FIRST_MODERN} then w else w + {size} end else 0 end as integer) as new_day from g
), c as (
  select *, case kind when 'card' then pn || cast((10 - {luhn_sum.format(d="pn", odd=0)} % 10) % 10 as varchar) when 'phone' then d[1:code] || pn
    when 'iban' then lpad(cast(98 - {mod97_of.format(z="blank")} as varchar), 2, '0') || pn end as q,
    lpad(cast(year(new_day) as varchar), 4, '0') as yy, lpad(cast(month(new_day) as varchar), 2, '0') as mm, lpad(cast(day(new_day) as varchar), 2, '0') as dd,
    repeat(h, 4)[1 : len(x) - len(pre)] as hidden from c0
), y as (
  select doc_id, i, kind, case when kind in ({kinds}) then {laid.format(x="x", d="q", marks="[^0-9]")}
    when kind = 'ip' then cast(w >> 24 as varchar) || '.' || cast((w >> 16) % 256 as varchar) || '.' || cast((w >> 8) % 256 as varchar) || '.' || cast(w % 256 as varchar)
    when kind = 'ip6' then {laid.format(x="x", d="h", marks=":")}
    when kind = 'date' then case ord when 'ymd' then yy || x[5] || mm || x[5] || dd when 'mdy' then mm || x[3] || dd || x[3] || yy else dd || x[3] || mm || x[3] || yy end
    when kind = 'ssn' then lpad(cast(w // 989901 + case when w // 989901 + 1 >= 666 then 2 else 1 end as varchar), 3, '0') || '-' || lpad(cast(w % 989901 // 9999 + 1 as varchar), 2, '0') || '-' || lpad(cast(w % 9999 + 1 as varchar), 4, '0')
    when kind = 'email' then 'user-' || h[1:12] || '@' || h[13:20] || '.invalid'
    when kind = 'secret' then pre || case when upper(x) = x or ({hexadecimal} and lower(x) <> x) then upper(hidden) else hidden end
    else x end as y from c
), z as (
  select doc_id, list(y order by i) as ys, {", ".join(f"cast(count(*) filter (kind = '{n}') as integer) as n_{n}" for n in KINDS)} from y group by doc_id
)
select d.doc_id, case when z.doc_id is null then d.text else array_to_string(list_transform(range(1, len(segs) + 1), lambda j: segs[j] || coalesce(ys[j], '')), '') end as text,
  {", ".join(f"coalesce(n_{n}, 0) as n_{n}" for n in KINDS)}
from documents d left join t using (doc_id) left join z using (doc_id)
"""
