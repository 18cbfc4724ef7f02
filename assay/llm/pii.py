"""Personal data: detection and keyed surrogates, with DataFrame and SQL functions only.

Detection is one alternation of patterns, without a repeated group that could recurse (loops are possessive or
bounded), so that texts of any length pass. The documents are read twice: once to stage those with a match, with
their mentions, and once for all others, which go nowhere else.

Mentions of one entity (the same e-mail address in any case, the same phone number in any notation) share a
canonical form, and so a surrogate (coreference). Names are replaced part by part: a given name or surname is an
entity of its own wherever it stands, so "Mr. Smith" and "John Smith" get one surname; and in a document that
names someone, its first word or surname is replaced where it stands alone too. The given name is all that
precedes the surname (so "John F. Kennedy" and "John Kennedy" differ in it), particles (van der, de la) belong to the
surname, titles stay. A name is found by a title or a listed given name before it, in any script with
capitals; up to four parts after its titles, up to three after a given name.

A surrogate is a keyed function of the canonical form and keeps type and format: digits for digits, letters for
letters, upper case for upper case, separators, country code and issuer digit, a 555 exchange, a valid Luhn digit
where there was one, the script of a name (Latin, Cyrillic, Greek, else Latin), and its gender where a title,
a listed given name or a Russian surname's ending shows one; a given name without a sign of gender gets a neutral one.
What varies of addresses, numbers, keys and secrets goes through a Feistel network over its characters, each within its class:
a permutation of the form's own values, so two entities of a form never meet.

Distinctness is checked all the same: surrogates that two entities of a type share (forms may overlap), or that
are themselves a real entity's canonical form (of a given name: its own), are drawn again with the next attempt number. What still collides
after ROUNDS takes free values by rank: a form's values are numbered, so many of them are listed that enough are
free, and an entity takes the free one of its own rank. A form with fewer values than twice the type's entities
gets digits appended first. So no entity is left without. A secret or key holds a letter or digit: a row of
signs (a form's blank, an underlined heading) isn't one. Ten digits without separators are a phone number if area and exchange can be
ones; an IPv6 address is one in any notation, and its surrogate is written out; addresses hold letters of any script. The entity table is joined, not broadcast by hint: the
optimizer may broadcast it when its measured size is small, and splits a hot entity's mentions when it isn't.

Defined results: null text stays null with 0 entities, empty text stays empty; a very long text is one row and takes
memory for itself and its mentions; bytes that are not valid UTF-8 are no letters or digits and stay as they are unless a
mention holds them; a null id stays null; repeated rows get the same text; an empty table gives an empty table; all
columns pass through, whatever their names (one that is named as the struct gives it a sign behind its own).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import free, staged

# Given names by script and gender, syllables of surrogate surnames.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Peter Hans Klaus Pierre Jean Carlos Juan".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Laura Julia Emma Greta Heidi Claire Sophie Maria Carmen".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
}
NEUTRAL = {"latin": "Alex Robin Sam Kim Chris Pat Jordan Taylor Casey Morgan Jamie Riley Quinn Avery Rowan Sasha".split(), "cyrillic": "Саша Женя Валя".split(), "greek": "Φώτη Χάρη".split()}
GREEK = {"m": "Γιώργος Νίκος Κώστας Γιάννης Δημήτρης".split(), "f": "Μαρία Ελένη Άννα Σοφία Κατερίνα".split()}
SYLLABLES = {
    "latin": "bar ben cor dal den fer gar hal ken lan mar nor per ral sel tam".split(),
    "cyrillic": "бар вер гор дан зор кар лем мар нор пер рог сел тар фед хол чер".split(),
    "greek": "βαρ βεν γορ δαλ ζεν καρ λαν μαρ νορ περ ραλ σελ ταμ φερ χαλ ψαν".split(),
}
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Don"], "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Doña"]}

# A part of a name begins with a capital of any script and goes on over hyphens and apostrophes (O'Brien, but not Smith's).
_end = r"(?![\p{L}\p{M}])"
_part = rf"(?:[dl]['’]|[ae]l-)?\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:[-‐'’](?!(?:s|d|m|t|ll|re|ve){_end})\p{{L}}[\p{{L}}\p{{M}}]*+)*+"
_led = rf"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|zu|zur|bin|ibn|y) ){{0,4}}(?:\p{{Lu}}\.(?: |(?=\p{{Lu}}))){{0,6}}{_part}"
_given = "|".join(n for names in GIVEN.values() for n in names)
_titles = "|".join(TITLES["m"] + TITLES["f"] + ["Dr", "Prof"])
_group = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}+(?:\.[\p{L}\p{M}\p{N}-]{1,63}+)++",
    "secret": r"""(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,2}[:=]\s{0,2}["']?(?=[_./+=-]*+[A-Za-z0-9])[A-Za-z0-9_./+=-]{8,}+""",
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp_|gho_|glpat-|xox[abp]-|sk-)(?=[_-]*+[A-Za-z0-9])[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[A-Z0-9]{0,26}[0-9]{4})[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9][0-9 ().-]{7,17}[0-9]|(?<![\p{L}\p{N}._+-])1?[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9]{6}(?![\p{L}\p{N}_-]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:{_group}(?::{_group}){{7}}|(?=[A-Fa-f:]{{0,39}}[0-9]){_group}(?::{_group}){{0,5}}::(?:{_group}(?::{_group}){{0,4}})?)(?![\p{{L}}\p{{N}}:]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{M}}])(?:(?:(?:{_titles})\.? ){{1,4}}{_led}(?: {_led}){{0,3}}|(?:{_given})(?:[-‐]\p{{L}}[\p{{L}}\p{{M}}]*+)*+(?: {_led}){{1,3}}){_end}",
}
ALL = "|".join(PATTERNS.values())
#: In a document that names someone, any capitalised word may be a part of that name.
WORD = rf"(?<![\p{{L}}\p{{M}}]){_part}"
BOTH = f"{ALL}|{WORD}"
# What every match of a pattern holds, in signs that are quickly looked for.
SIGNS = {
    "email": "@", "secret": "[=:]", "key": "(?:AKIA|ASIA)[A-Z0-9]|(?:ghp_|gho_|glpat-|xox[abp]-|sk-)", "ip6": ":",
    "iban": "[0-9][0-9 .()-]{2}", "ssn": "[0-9][0-9 .()-]{2}", "card": "[0-9][0-9 .()-]{2}", "phone": "[0-9][0-9 .()-]{2}", "ip": "[0-9][0-9 .()-]{2}",
    "name": rf"(?<![\p{{L}}])(?=[A-ZА-Я])(?:{_titles}|{_given})(?![\p{{L}}\p{{M}}])",
}
#: Says no quickly for most texts; says yes for every text with a match.
HINT = "|".join(dict.fromkeys(SIGNS[kind] for kind in PATTERNS))
ROUNDS = 50


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """Type of a mention: the first pattern that it matches whole; a word by itself is of type word."""
    out = F.when(mention.rlike(f"^(?:{PATTERNS['name']})$"), "name").otherwise("word")
    for kind in ("ip6", "ip", "phone", "card", "ssn", "iban", "key", "secret", "email"):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _value(mention: Column) -> Column:
    """What is replaced of a secret: all after the sign and an opening quote."""
    return F.regexp_extract(mention, r"""^[^:=]*[:=]\s*["']?(.*)$""", 1)


def _bare(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:(?:{_titles})\.? )+(?=.)", "")


#: SQL: eight groups of four digits of an address in any notation, of a column `mention`.
_GROUPS = "filter(split(lower({0}), ':'), x -> x <> '')"
_LEFT, _RIGHT = (_GROUPS.format(f"split_part(mention, '::', {k})") for k in (1, 2))
_LONG = f"array_join(transform(if(instr(mention, '::') > 0, concat({_LEFT}, array_repeat('0', 8 - size({_LEFT}) - size({_RIGHT})), {_RIGHT}), split(lower(mention), ':')), x -> lpad(x, 4, '0')), ':')"


def canonical(kind: Column, mention: Column) -> Column:
    """Of names: of one part."""
    digits = _digits(mention)
    return (
        F.when(kind.isin("email", "name", "word"), F.lower(mention))
        .when(kind == "secret", _value(mention))
        .when(kind.isin("ip", "key"), mention)
        .when(kind == "ip6", F.expr(_LONG))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when((kind == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
        .otherwise(digits)
    )


def _listed(gender: str) -> list[str]:
    return [n.lower() for (_, g), names in GIVEN.items() if g == gender for n in names]


def _gender(role: Column, title: Column, part: Column) -> Column:
    """Of a given name, by title or list; of a surname, by a Russian ending; u if nothing shows it."""
    first = F.element_at(F.split(F.lower(part), "[ ‐-]"), 1)
    titled = lambda g: title.rlike(rf"(?:^| )(?:{'|'.join(TITLES[g])})\.? ")
    given = F.when(first.isin(_listed("m")), "m").when(first.isin(_listed("f")), "f").when(titled("m"), "m").when(titled("f"), "f").otherwise("u")
    surname = F.when(part.rlike("[а-яё](ова|ева|ёва|ина|ына|ая)$"), "f").when(part.rlike("[а-яё](ов|ев|ёв|ин|ын|ий)$"), "m").otherwise("u")
    return F.when(role == "given", given).otherwise(surname)


def _sql_list(names: list[str]) -> str:
    return f"array({', '.join(repr(x) for x in names)})"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, gender, role, attempt) with surrogate: its canonical form."""
    key = hashlib.sha256(key.encode()).hexdigest()  # safe in an expression, and plans don't show the key itself
    if "role" not in entities.columns:
        entities = entities.withColumn("role", F.lit("surname"))
    seed = lambda *more: f"concat_ws('|', '{key}', kind, cast(attempt as string), {', '.join(more)})"
    df = entities.withColumn("h", F.expr(f"concat(sha2({seed('canon')}, 256), sha2({seed('canon', repr('more'))}, 256))"))
    kind, n = F.col("kind"), F.length("canon")
    plain = (kind == "phone") & (n == 10)
    exchange = plain & (F.substring("canon", 4, 3) == "555") & (F.col("attempt") < 3)
    part = (
        F.when(kind == "email", F.substring_index("canon", "@", 1))
        .when(kind == "key", F.expr("substr(canon, 5)"))
        .when(kind == "iban", F.expr("substr(canon, 3)"))
        .when(kind == "card", F.expr("substr(canon, 2, length(canon) - 2)"))
        .when(exchange, F.concat(F.substring("canon", 2, 2), F.substring("canon", 7, 4)))
        .when(plain, F.concat(F.substring("canon", 2, 2), F.substring("canon", 5, 6)))
        .when(kind.isin("ip", "name"), "")
        .when(kind == "ip6", F.replace("canon", F.lit(":"), F.lit("")))
        .otherwise(F.col("canon"))
    )
    df = df.withColumn("part", part).withColumn("letters", F.when(F.col("part").rlike("^[0-9a-f]{8,}$"), 6).otherwise(26))
    df = df.withColumn("a", F.expr("substr(part, 1, (length(part) + 1) div 2)")).withColumn("b", F.expr("substr(part, (length(part) + 1) div 2 + 1)"))
    for i in range(3):
        for own, other in (("a", "b"), ("b", "a")):
            df = df.withColumn(own, F.expr(_shifted(own, seed(f"'{i}{own}'", "length(part)", other))))
    df = df.withColumn("alike", F.concat("a", "b"))
    lead = lambda at, salt: F.expr(f"transform(array(sha2({seed(repr(salt), 'alike')}, 256)), hh -> case when substr(canon, {at}, 1) >= '2' then cast((cast(substr(canon, {at}, 1) as int) - 2 + cast(conv(substr(hh, 1, 2), 16, 10) as int)) % 8 + 2 as string) else cast((cast(substr(canon, {at}, 1) as int) + cast(conv(substr(hh, 1, 2), 16, 10) as int)) % 2 as string) end)[0]")
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index("canon", "@", -1)), 256)
    df = df.withColumn("body", F.when(kind == "card", F.concat(F.substring("canon", 1, 1), "alike")))
    # the original passes Luhn if its own last digit is the one that its body asks for
    real = F.expr(LUHN.replace("reverse(body)", "reverse(substr(canon, 1, length(canon) - 1))"))
    off = F.expr(f"cast((cast({LUHN} as int) + 1 + cast(conv(substr(h, 1, 2), 16, 10) as int) % 9) % 10 as string)")
    df = df.withColumn("last", F.when((kind == "card") & (F.substring("canon", -1, 1) == real), F.expr(LUHN)).otherwise(off))
    octet = lambda i: F.expr(f"cast(cast(conv(substr(h, {2 * i + 1}, 2), 16, 10) as int) as string)")
    made = (
        F.when(kind == "email", F.concat("alike", F.lit("@mx"), F.substring(domain, 1, 8), F.lit(".example.com")))
        .when(kind == "key", F.concat(F.substring("canon", 1, 4), F.col("alike")))
        .when(kind == "iban", F.concat(F.substring("canon", 1, 2), F.col("alike")))
        .when(kind == "card", F.concat("body", "last"))
        .when(kind == "ip", F.concat_ws(".", F.lit("10"), octet(0), octet(1), octet(2)))
        .when(kind == "name", F.lower(F.expr(_name_sql())))
        .when(kind == "ip6", F.expr("array_join(transform(sequence(0, 7), i -> substr(alike, 4 * i + 1, 4)), ':')"))
        .when(exchange, F.concat(lead(1, "area"), F.substring("alike", 1, 2), F.lit("555"), F.substring("alike", 3, 4)))
        .when(plain, F.concat(lead(1, "area"), F.substring("alike", 1, 2), lead(4, "office"), F.substring("alike", 3, 6)))
        .otherwise(F.col("alike"))
    )
    return df.select("kind", "canon", "gender", "role", "attempt", made.alias("surrogate"))


# Letters beyond a-z that stand for each other in addresses.
LETTERS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω")


def _shifted(x: str, seed: str) -> str:
    """SQL: each letter and digit of a column moved within its class by a keyed hash; other signs stay."""
    step = "cast(conv(substr(hh, 2 * (i % 32) + 1, 2), 16, 10) as int)"
    return f"""transform(array(sha2({seed}, 256)), hh -> array_join(transform(split({x}, ''), (c, i) -> case
        when c rlike '^[a-f]$' and letters = 6 then chr(97 + (ascii(c) - 97 + {step}) % 6)
        when c rlike '^[a-z]$' then chr(97 + (ascii(c) - 97 + {step}) % 26)
        when c rlike '^[A-Z]$' then chr(65 + (ascii(c) - 65 + {step}) % 26)
        when c rlike '^[0-9]$' then cast((cast(c as int) + {step}) % 10 as string)
        {" ".join(f"when c <> '' and locate(c, '{x}') > 0 then substr('{x}', (locate(c, '{x}') - 1 + {step}) % {len(x)} + 1, 1)" for x in LETTERS)} else c end), ''))[0]"""


_ODD = "transform(split(reverse(body), ''), (c, i) -> if(i % 2 = 0, if(2 * int(c) > 9, 2 * int(c) - 9, 2 * int(c)), int(c)))"
LUHN = f"cast((10 - aggregate({_ODD}, 0, (a, x) -> a + x) % 10) % 10 as string)"


def _name_sql() -> str:
    """SQL: a part of a name from h, canon, gender, role and attempt. A given name is a listed one, after some attempts two of them, then one with syllables."""
    script = "case when canon rlike '[а-яё]' then 'cyrillic' when canon rlike '[α-ωά-ώ]' then 'greek' else 'latin' end"
    at = lambda i: f"cast(conv(substr(h, {4 * i + 1}, 4), 16, 10) as int)"

    def pick(names: list[str], i: int) -> str:
        return f"element_at({_sql_list(names)}, {at(i)} % {len(names)} + 1)"

    def syllables(name: str, first: int, least: str) -> str:
        return f"array_join(transform(sequence(1, {least}), k -> element_at({_sql_list(SYLLABLES[name])}, cast(conv(substr(h, ({4 * first} + 4 * k) % 120 + 1, 2), 16, 10) as int) % 16 + 1)), '')"

    given, surname = [], []
    for name in SYLLABLES:
        lists = {"m": GIVEN.get((name, "m"), GREEK["m"]), "f": GIVEN.get((name, "f"), GREEK["f"]), "u": NEUTRAL[name]}
        one = lambda i: f"case gender when 'm' then {pick(lists['m'], i)} when 'f' then {pick(lists['f'], i)} else {pick(lists['u'], i)} end"  # noqa: B023, E731
        given.append(f"when '{name}' then case when attempt < 4 then {one(0)} when attempt < 8 then concat({one(0)}, '-', {one(1)}) else concat({one(0)}, '-', {syllables(name, 4, 'attempt div 4 - 1')}) end")
        ending = "case gender when 'm' then 'ов' when 'f' then 'ова' else '' end" if name == "cyrillic" else "''"
        surname.append(f"when '{name}' then concat({syllables(name, 0, '3 + attempt div 2')}, {ending})")
    return f"case when role = 'given' then case {script} {' '.join(given)} end else case {script} {' '.join(surname)} end end"


def _ranked(df: DataFrame, keys: list[str], by: Column, name: str) -> DataFrame:
    """df with its rows' ranks from 1 within keys; no task holds all rows of a large key."""
    df = df.withColumn("_by", by).withColumn("_cell", F.pmod(F.col("_by"), F.lit(1024)))
    cells = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_by"))
    return df.withColumn("_within", within).join(cells, [*keys, "_cell"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_by", "_cell", "_before", "_within")


FORM = ["kind", "head", "form", "tail"]


def _forms(bad: DataFrame, sizes: DataFrame) -> DataFrame:
    """bad with the form of each surrogate: fixed head and tail, a sign for each character that varies, number of values."""
    kind, s = F.col("kind"), F.col("surrogate")
    head = F.when(kind == "key", F.substring(s, 1, 4)).when(kind == "iban", F.substring(s, 1, 2)).when(kind == "card", F.substring(s, 1, 1)).otherwise("")
    luhn = F.expr(LUHN.replace("reverse(body)", "reverse(substr(surrogate, 1, length(surrogate) - 1))"))
    tail = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(s, "@", -1))).when(kind == "name", F.regexp_extract(s, "(ова?)$", 1)).when(kind == "card", F.when(F.substring(s, -1, 1) == luhn, "valid").otherwise("not")).otherwise("")
    part = F.when(kind == "email", F.substring_index(s, "@", 1)).when(kind == "card", F.expr("substr(surrogate, 2, length(surrogate) - 2)")).when(kind.isin("key", "iban"), F.expr("substr(surrogate, length(head) + 1)")).otherwise(s)
    df = bad.withColumn("head", head).withColumn("tail", tail).withColumn("part", part)
    signs = F.expr("regexp_replace(regexp_replace(regexp_replace(part, '[0-9]', '9'), '[A-Z]', 'Z'), '[a-z]', if(part rlike '^[0-9a-f:]{8,}$', 'f', 'z'))")
    df = df.withColumn("form", F.when(kind == "ip", "ip").when(kind == "name", F.when(s.rlike("[а-яё]"), "cyrillic").when(s.rlike("[α-ωά-ώ]"), "greek").otherwise("latin")).otherwise(signs))
    room = "case kind when 'ip' then 989D * 16777216 when 'name' then 1e18 else least(1e18, aggregate(split(form, ''), 1D, (a, c) -> a * case c when '9' then 10D when 'f' then 6D when 'z' then 26D when 'Z' then 26D else 1D end)) end"
    df = df.join(sizes, "kind")
    longer = F.when(F.expr(f"{room} < 2 * size"), F.expr("concat(form, repeat('9', length(cast(2 * size as string))))")).otherwise(F.col("form"))
    df = df.withColumn("form", F.when(kind.isin("ip", "name", "card"), F.col("form")).otherwise(longer))
    return df.withColumn("room", F.expr(f"cast({room} as bigint)")).drop("part", "size")


def _value_of_form() -> Column:
    """The value of number j of a form."""
    put = lambda digit, radix: f"named_struct('s', concat({digit}, a.s), 'r', a.r div {radix})"
    spelt = f"""aggregate(reverse(split(form, '')), named_struct('s', '', 'r', j), (a, c) -> case c when '9' then {put("cast(a.r % 10 as string)", 10)}
        when 'f' then {put("chr(97 + a.r % 6)", 6)} when 'z' then {put("chr(97 + a.r % 26)", 26)} when 'Z' then {put("chr(65 + a.r % 26)", 26)}
        else named_struct('s', concat(c, a.s), 'r', a.r) end).s"""
    name = lambda script: f"array_join(transform(split(lpad(hex(j), greatest(8, length(hex(j))), '0'), ''), x -> element_at(array({', '.join(repr(x) for x in SYLLABLES[script])}), cast(conv(x, 16, 10) as int) + 1)), '')"
    first = "if(j < 16777216, 10, (j div 16777216 - 1) + if(j div 16777216 - 1 >= 10, 1, 0))"
    card = f"transform(array(concat(head, {spelt})), body -> concat(body, cast((cast({LUHN} as int) + if(tail = 'valid', 0, 1)) % 10 as string)))[0]"
    return F.expr(f"""case kind when 'ip' then concat_ws('.', {first}, j div 65536 % 256, j div 256 % 256, j % 256) when 'card' then {card}
        when 'name' then concat(head, case form when 'cyrillic' then {name("cyrillic")} when 'greek' then {name("greek")} else {name("latin")} end, tail) else concat(head, {spelt}, tail) end""")


def assigned(bad: DataFrame, held: DataFrame, sizes: DataFrame, key: str, width: int) -> DataFrame:
    """bad with free values by rank, out of the first `width` values for each entity of a form; rows for which that's too few stay."""
    ranked = _ranked(_forms(bad, sizes), FORM, F.xxhash64(F.lit(key), "canon"), "rank")
    n = ranked.groupBy(*FORM).agg(F.expr(f"cast(least(count(1) * {float(width)}D, max(room)) as bigint)").alias("n"))
    n = n.withColumn("at", F.explode(F.expr("sequence(0L, (n - 1) div 65536)"))).repartition(*FORM, "at")
    values = n.withColumn("j", F.explode(F.expr("sequence(at * 65536, least(n - 1, at * 65536 + 65535))")))
    free = values.select(*FORM, _value_of_form().alias("free")).join(held.withColumnRenamed("surrogate", "free"), ["kind", "free"], "left_anti")
    out = ranked.join(_ranked(free, FORM, F.xxhash64(F.lit(key), "free"), "rank"), [*FORM, "rank"], "left")
    return out.select("kind", "canon", "gender", "role", "attempt", F.coalesce("free", "surrogate").alias("surrogate"))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Surrogates of all entities, drawn again wherever two collide or one is a real entity, assigned by rank at last."""
    if "role" not in entities.columns:
        entities = entities.withColumn("role", F.lit("surname"))
    found = staged(surrogates(entities.withColumn("attempt", F.lit(0)), key), "pii-entities")
    for n in range(ROUNDS + 62):
        # all given names in use are given to someone else too; what a text needs is that a surrogate isn't its own original
        real = found.where("role <> 'given'").select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        marked = found.withColumn("rank", rank).join(real, ["kind", "surrogate"], "left")
        bad = (F.col("rank") > 1) | (F.col("real").isNotNull() & (F.col("role") != "given")) | (F.col("surrogate") == F.col("canon"))
        if marked.where(bad).isEmpty():
            return found
        again = marked.where(bad).select("kind", "canon", "gender", "role", (F.col("attempt") + 1).alias("attempt"), "surrogate")
        if n < ROUNDS:
            again = surrogates(again.drop("surrogate"), key)
        else:
            held = marked.where(~bad).select("kind", "surrogate").unionByName(real.drop("real"))
            again = assigned(again, held, found.groupBy("kind").agg(F.count(F.lit(1)).alias("size")), key, 2 ** (n - ROUNDS))
        found = staged(marked.where(~bad).select(*again.columns).unionByName(again), "pii-entities")
    raise RuntimeError("surrogates still collide; the space of one type is used up")


def _worded(kind: Column, mention: Column, surrogate: str) -> Column:
    """The mention (of a name: the part) in the surrogate's words, in its own notation."""
    nth = "length(regexp_replace(substr(mention, 1, i + 1), '[^0-9]', '')) - length(regexp_replace(mention, '[^0-9]', '')) + length(surrogate)"
    numbers = F.expr(f"array_join(transform(split(mention, ''), (c, i) -> if(c rlike '[0-9]' and {nth} > 0, if({nth} = 1 + length(surrogate) - length(regexp_replace(mention, '[^0-9]', '')), substr(surrogate, 1, {nth}), substr(surrogate, {nth}, 1)), c)), '')")
    cased = F.expr("concat(array_join(transform(split(substring_index(surrogate, '@', 1), ''), (c, i) -> if(substr(mention, i + 1, 1) rlike '\\\\p{Lu}', upper(c), c)), ''), '@', substring_index(surrogate, '@', -1))")
    part = F.when((F.length(mention) > 1) & (mention == F.upper(mention)), F.upper(F.col(surrogate))).otherwise(F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-"))
    return (
        F.when(kind == "email", cased)
        .when(kind == "secret", F.concat(F.expr("substr(mention, 1, length(mention) - length(canon))"), F.col(surrogate)))
        .when(kind.isin("name", "word"), part)
        .when(kind.isin("ip", "ip6", "key"), F.col(surrogate))
        .when(kind == "iban", F.expr("array_join(transform(split(mention, ''), (c, i) -> if(c = ' ', c, substr(surrogate, length(replace(substr(mention, 1, i + 1), ' ', '')), 1))), '')"))
        .otherwise(numbers)
    )


_TITLE = rf"^((?:{_titles})\.? )+(?=.)"


def _parts(kind: Column, mention: Column) -> Column:
    """Pieces of a mention as (text, role): of a name its title (role null), given name and surname; else the mention alone."""
    bare = _bare(mention)
    surname = F.regexp_extract(bare, r"(?:^| )((?:\p{Ll}+ )*+[^ ]+)$", 1)
    given = F.rtrim(F.substr(bare, F.lit(1), F.length(bare) - F.length(surname)))
    title = F.rtrim(F.regexp_extract(mention, _TITLE, 0))
    piece = lambda text, role: F.struct(text.alias("text"), F.lit(role).cast("string").alias("role"))
    # a listed given name after a title, alone, is still one
    alone = F.when(F.lower(surname).isin(_listed("m") + _listed("f")), "given").otherwise("surname")
    last = F.struct(surname.alias("text"), F.when(given == "", alone).otherwise("surname").alias("role"))
    names = F.filter(F.array(piece(title, None), piece(given, "given"), last), lambda x: x["text"] != "")
    return F.when(kind == "name", names).otherwise(F.array(piece(mention, "whole")))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", into: str = "pii") -> DataFrame:
    """docs with the text's entities replaced, and a struct (`into`): n_entities long."""
    columns = docs.columns
    into = free(into, columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ALL), F.lit(False))
    clean = rows.where(~has).select("row", "text", F.lit(0).cast("bigint").alias("n_entities"))
    # documents with a match, and in those that name someone the words too; repeated rows share their keys
    named = F.col("text").rlike(PATTERNS["name"])
    spans = F.when(named, F.regexp_extract_all("text", F.lit(BOTH), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(ALL), F.lit(0)))
    gaps = F.when(named, F.split("text", BOTH, -1)).otherwise(F.split("text", ALL, -1))
    hits = staged(rows.where(has).select("row", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit("k2"), "id").alias("k2"), spans.alias("spans"), gaps.alias("gaps")), "pii-hits")

    found = hits.select("k1", "k2", F.posexplode("spans").alias("pos", "span")).dropDuplicates(["k1", "k2", "pos"])
    found = found.withColumn("kind", kind_of(F.col("span"))).withColumn("title", F.when(F.col("kind") == "name", F.regexp_extract("span", _TITLE, 0)).otherwise(""))
    pieces = found.select("k1", "k2", "pos", "kind", "title", F.posexplode(_parts(F.col("kind"), F.col("span"))).alias("sub", "p"))
    pieces = pieces.select("k1", "k2", "pos", "sub", "kind", "title", F.col("p.text").alias("mention"), F.col("p.role").alias("role"))
    pieces = staged(pieces.withColumn("canon", F.when(F.col("role").isNotNull(), canonical(F.col("kind"), F.col("mention")))), "pii-mentions")
    # a word alone is an entity if the document names someone of whom it is a part
    parts = pieces.where("kind = 'name' and role is not null")
    entities = pieces.where("kind not in ('name', 'word')").select("kind", "canon", F.lit("u").alias("gender"), F.lit("whole").alias("role"))
    named = parts.select("kind", "canon", _gender(F.col("role"), F.col("title"), F.col("mention")).alias("gender"), "role")
    # one known gender and the role of a given name hold for all mentions
    entities = entities.unionByName(named).groupBy("kind", "canon").agg(F.min("gender").alias("gender"), F.min("role").alias("role"))
    table = distinct_surrogates(entities, key).select("kind", "canon", "surrogate")

    token = F.when(F.col("role") == "given", F.element_at(F.split("canon", " "), 1)).otherwise(F.element_at(F.split("canon", " "), -1))
    owners = parts.select("k1", "k2", token.alias("canon"), F.struct("role", F.col("canon").alias("of")).alias("o")).groupBy("k1", "k2", "canon").agg(F.min("o").alias("o"))
    words = pieces.where("kind = 'word'").join(owners, ["k1", "k2", "canon"]).select("k1", "k2", "pos", F.col("o.of").alias("of"))
    both = pieces.join(words, ["k1", "k2", "pos"], "left")
    both = both.withColumn("as", F.when(F.col("kind") == "word", F.when(F.col("of").isNotNull(), "name")).otherwise(F.col("kind"))).withColumn("canon", F.coalesce("of", "canon"))
    worded = both.join(table.select(F.col("kind").alias("as"), "canon", "surrogate"), ["as", "canon"], "left")
    new = F.when(F.col("surrogate").isNotNull(), _worded(F.col("kind"), F.col("mention"), "surrogate")).otherwise(F.col("mention"))
    worded = worded.select("k1", "k2", "pos", "sub", new.alias("new"), F.col("surrogate").isNotNull().alias("hit")).repartition("k1", "k2")
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "new"))), lambda x: x["new"]), " ")
    spoken = worded.groupBy("k1", "k2", "pos").agg(glued.alias("new"), F.bool_or("hit").alias("hit"))
    by_doc = spoken.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("news"), F.count_if("hit").alias("n_entities"))
    joined = hits.join(by_doc, ["k1", "k2"])
    text = F.concat_ws("", F.flatten(F.zip_with("gaps", F.concat(F.transform("news", lambda x: x["new"]), F.array(F.lit(""))), lambda g, n: F.array(g, n))))
    changed = joined.select("row", text.alias("text"), F.col("n_entities").cast("bigint").alias("n_entities"))
    out = clean.unionByName(changed)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns], F.struct("n_entities").alias(into))
