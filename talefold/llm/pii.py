"""Surrogates for personal data.

Entities are found by one pattern: mail addresses, IPv4 and IPv6 addresses, payment cards,
IBANs, phone and social security numbers, secrets, and names behind an honorific (with
initials and particles, in capitals too) or a known given name. A text that holds such a name
is looked through once more: its surnames are replaced wherever they stand, with a given name
in front of them in mid-sentence, and the given names so found wherever they stand. Initials
are exchanged by a keyed order of the alphabet. Each entity is brought to a canonical form, so that spellings of one
entity (case, separators) stay one entity; a name's given name and surname are
entities of their own, so a surname keeps its surrogate with and without given name
or honorific. A keyed SHA-256 of type and canonical form drives its surrogate: letters
become letters of the same script, digits digits, and each type keeps its rules (Luhn
remainder of cards, check digits of IBANs, octets of addresses, country codes of phone
numbers, gender and script of names). Surrogates that two entities of any type share, or
that are entities of the corpus themselves, are drawn anew with the next counter until
all are distinct; from the seventh draw on, names and addresses grow by a syllable or
letter and numbers by a digit each time, so that no form can run out. Each occurrence
then takes its entity's surrogate in its own spelling.

Texts never go through a join unless they hold an entity. Only DataFrame functions
are used, and no pattern repeats a group without a bound. Defined cases: a null text
stays null and holds nothing; a text of any length is read as a whole; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, small

#: Honorifics by gender, given names by gender and script, and syllables of surnames by script.
HONORIFICS = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Signora Госпожа Κυρία", "m": "Mr Herr Monsieur Señor Sr Signor Господин Κύριος", "u": "Dr Prof"}
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Laura Julia Sofia Clara Elena Lucia Nora Alice Irene Martha Helen Paula Greta Sarah Emily Mary Claire",
    ("m", "latin"): "Peter Thomas Daniel Martin Lucas Simon David Paul Oscar Victor Hugo Felix Adam Robert Leon Anton John James Michael Pierre",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Вера Нина Ирина Дарья",
    ("m", "cyrillic"): "Иван Пётр Олег Борис Павел Антон Игорь Денис",
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Δήμητρα",
    ("m", "greek"): "Νίκος Γιώργος Πέτρος Παύλος Κώστας Ανδρέας",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se ta te to",
    "cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то",
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το",
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцч", "greek": "αβγδεζηθικλμνξοπρτυφχψω"}

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}[\p{L}'’-]{0,63}+"
#: Calling codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_NAMES = "|".join(sorted({m for x in GIVEN.values() for n in x.split() for m in (n, n.upper())}))
_TITLES = "|".join(sorted({m for x in HONORIFICS.values() for t in x.split() for m in (t, t.upper())}, key=lambda t: (-len(t), t)))
#: Words before a surname that stay, and letters that initials are taken from.
PARTICLES = "van von de der den del della di da dos du la le ter ten zu zum zur"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΤΥΦΧΨΩ"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES.split())}) ){{0,3}}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: type: pattern; the first that matches in full names an entity's type.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,20}(?<=\.\p{L}{2,24})",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[\p{{L}}\p{{N}}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "secret": _B + r"(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?[A-Za-z0-9_-]{16,128})" + _E,
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "card": _B + r"\d(?:[ -]?\d){12,18}" + _E,
    "phone": r"(?<![\p{L}\p{N}+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}[ /-]\d{6,8})" + _E,
    "name": _B + rf"(?=\p{{Lu}})(?:(?:(?:{_TITLES})\.? ){{1,3}}{_INITIALS}(?:{_WORD} {_INITIALS})?{_PARTICLE}{_WORD}|(?:{_NAMES}) {_INITIALS}{_WORD})",
}
#: All begin behind what is no letter or digit, which is asked once for all of them.
ANY = f"{_B}(?:{'|'.join(PATTERNS.values())})"
#: Also every capitalised word, for texts that hold names.
WIDE = f"{_B}(?:{'|'.join(PATTERNS.values())}|{_WORD})"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: str) -> str:
    return f"array({', '.join(map(_sql, words.split()))})"


def type_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


_BARE = rf"^(?:(?:{_TITLES})\.? ){{1,3}}"
#: Letters and digits of an entity alone, in one case; names without honorific.
CANON = f"""CASE kind
  WHEN 'email' THEN lower(value)
  WHEN 'ip' THEN value
  WHEN 'ip6' THEN lower(value)
  WHEN 'iban' THEN replace(value, ' ', '')
  WHEN 'secret' THEN IF(value RLIKE '^[0-9a-fA-F]+$', lower(value), value)
  WHEN 'phone' THEN concat(IF(value LIKE '+%', '+', ''), regexp_replace(value, '[^0-9]', ''))
  WHEN 'given' THEN lower(value)
  WHEN 'surname' THEN lower(value)
  ELSE regexp_replace(value, '[^0-9]', '') END"""
SCRIPT = "CASE WHEN value RLIKE '\\\\p{IsCyrillic}' THEN 'cyrillic' WHEN value RLIKE '\\\\p{IsGreek}' THEN 'greek' ELSE 'latin' END"


def _gender() -> str:
    titles = "split(lower(title), '[. ]+')"
    cases = [f"WHEN arrays_overlap({_list(HONORIFICS[g].lower())}, {titles}) THEN '{g}'" for g in "fm"]
    cases += [f"WHEN array_contains({_list(' '.join(v for (h, _), v in GIVEN.items() if h == g).lower())}, lower(value)) THEN '{g}'" for g in "fm"]
    return f"CASE WHEN kind <> 'given' THEN NULL {' '.join(cases)} END"


def _byte(i: str) -> str:
    """The i-th number, 0 to 255, of an entity's keyed stream."""
    return f"int(conv(substring(stream, 2 * pmod({i}, 128) + 1, 2), 16, 10))"


def _like(c: str, i: str) -> str:
    """A character of the class of c."""
    letters = " ".join(f"WHEN {c} RLIKE '\\\\p{{Is{s.title()}}}' THEN substring({_sql(x)}, 1 + pmod({_byte(i)}, {len(x)}), 1)" for s, x in LETTERS.items())
    small_ = f"CASE {letters} ELSE {c} END"
    return f"CASE WHEN {c} RLIKE '[0-9]' THEN string(pmod({_byte(i)}, 10)) WHEN {c} RLIKE '\\\\p{{Lu}}' THEN upper({small_}) WHEN {c} RLIKE '\\\\p{{L}}' THEN {small_} ELSE {c} END"


def _each(text: str, of: str, start: int = 0) -> str:
    """Joins of(c, i) over the characters of text."""
    one = of.replace("$c", f"substring({text}, i + 1, 1)").replace("$i", f"(i + {start})")
    return f"array_join(IF(length({text}) = 0, CAST(array() AS array<string>), transform(sequence(0, length({text}) - 1), i -> {one})), '')"


def _luhn(text: str) -> str:
    """Luhn sum of a number's digits modulo 10."""
    digit = f"int(substring({text}, length({text}) - i, 1))"
    return f"aggregate(transform(sequence(0, length({text}) - 1), i -> IF(i % 2 = 0, {digit}, IF({digit} > 4, 2 * {digit} - 9, 2 * {digit}))), 0, (a, x) -> a + x, a -> a % 10)"


def _mod97(text: str) -> str:
    """Remainder by 97 of a text whose letters count as 10 to 35."""
    value = f"int(conv(substring({text}, i + 1, 1), 36, 10))"
    return f"aggregate(transform(sequence(0, length({text}) - 1), i -> {value}), 0, (a, x) -> IF(x > 9, (a * 100 + x) % 97, (a * 10 + x) % 97))"


def _with_core(entities: DataFrame, key: str) -> DataFrame:
    """core: the surrogate, in canonical form, of each entity(kind, canon, gender, script, draw)."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("draw").cast("string"))
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{n}")), 256) for n in range(4)))
    out = entities.withColumn("stream", stream)
    extra = "greatest(0, draw - 5)"
    any_ = _like("$c", "$i")
    out = out.withColumn("form", F.expr(f"IF(kind IN ('card', 'phone', 'ssn', 'iban', 'secret'), concat(canon, repeat('0', {extra})), canon)"))
    out = out.withColumn("body", F.expr(_each("form", any_)))
    hexes = _each("form", f"substring('0123456789abcdef', 1 + pmod({_byte('$i')}, 16), 1)")
    groups = _each("canon", f"IF($c = ':', ':', substring('0123456789abcdef', 1 + pmod({_byte('$i')}, 16), 1))")
    code = f"CASE WHEN canon NOT LIKE '+%' THEN 1 WHEN instr('{ONE_DIGIT}', substring(canon, 2, 1)) > 0 THEN 2 WHEN array_contains({_list(TWO_DIGITS)}, substring(canon, 2, 2)) THEN 3 ELSE 4 END"
    out = out.withColumn("code", F.expr(code))
    # Area codes and exchanges behind +1 begin with 2 to 9.
    digits = _each("form", f"CASE WHEN $i < code THEN $c WHEN canon LIKE '+1%' AND $i IN (2, 5) THEN string(2 + pmod({_byte('$i')}, 8)) ELSE string(pmod({_byte('$i')}, 10)) END")
    out = out.withColumn("digits", F.expr(f"CASE WHEN kind IN ('card', 'phone', 'ssn') THEN {digits} END"))
    # A card's last digit gives the number the remainder that the original has.
    out = out.withColumn("card", F.expr("CASE WHEN kind = 'card' THEN concat(substring(digits, 1, length(digits) - 1), '0') END"))
    out = out.withColumn("card", F.expr(f"CASE WHEN kind = 'card' THEN concat(substring(card, 1, length(card) - 1), string(pmod({_luhn('canon')} - {_luhn('card')}, 10))) END"))
    out = out.withColumn("account", F.expr("CASE WHEN kind = 'iban' THEN concat(substring(body, 5), substring(canon, 1, 2), '00') END"))
    syllables = {s: f"array_join(transform(sequence(1, 3 + {extra}), i -> element_at({_list(x)}, 1 + pmod({_byte('i + 3')}, {len(x.split())}))), '')" for s, x in SYLLABLES.items()}
    surname = "CASE script " + " ".join(f"WHEN '{s}' THEN {x}" for s, x in syllables.items()) + " END"
    one = lambda x, i: f"element_at({_list(x)}, 1 + pmod({_byte(i)}, {len(x.split())}))"
    # A given name, then two of them, then a surname's syllables behind these.
    givens = " ".join(f"WHEN pick = '{g}' AND script = '{s}' THEN concat({one(x, '1')}, IF(draw < 3, '', concat('-', {one(x, '40')})))" for (g, s), x in GIVEN.items())
    out = out.withColumn("pick", F.expr(f"coalesce(gender, IF({_byte('2')} < 128, 'f', 'm'))"))
    core = f"""CASE kind
      WHEN 'email' THEN concat(substring_index(body, '@', 1), IF(draw > 5, concat('.', array_join(transform(sequence(1, {extra}), i -> substring('{LETTERS['latin']}', 1 + pmod({_byte('i + 70')}, 26), 1)), '')), ''),
        '@', substring_index(substring_index(body, '@', -1), '.', size(split(substring_index(body, '@', -1), '\\\\.')) - 1), '.', substring_index(canon, '.', -1))
      WHEN 'ip' THEN array_join(transform(sequence(0, 3), i -> string(1 + pmod({_byte('i')}, 254))), '.')
      WHEN 'ip6' THEN {groups}
      WHEN 'iban' THEN concat(substring(canon, 1, 2), lpad(string(98 - {_mod97('account')}), 2, '0'), substring(body, 5))
      WHEN 'secret' THEN IF(canon RLIKE '^[0-9a-f]+$', {hexes}, concat(regexp_extract(canon, '^(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?', 0), substring(body, 1 + length(regexp_extract(canon, '^(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?', 0)))))
      WHEN 'card' THEN card
      WHEN 'given' THEN lower(concat(CASE {givens} END, IF(draw < 6, '', concat('-', {surname}))))
      WHEN 'surname' THEN {surname}
      ELSE digits END"""
    return out.withColumn("core", F.expr(core)).drop("stream", "form", "code", "body", "digits", "card", "account", "pick")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, core of distinct entities(kind, canon, gender, script); no two have one core, and no core is an entity."""
    left = entities.withColumn("draw", F.lit(0))
    taken = entities.select(F.col("canon").alias("core"))
    done = None
    while True:  # forms grow with the draws, so all find a core
        drawn = _with_core(left, key)
        free = drawn.join(taken, "core", "left_anti")
        winners = free.groupBy("core").agg(F.min(F.struct("kind", "canon")).alias("of"))
        now = cut(winners.select("of.kind", "of.canon", "core"))
        done = now if done is None else done.unionByName(now)
        left = cut(left.join(now, ["kind", "canon"], "left_anti").withColumn("draw", F.col("draw") + 1))
        if left.isEmpty():
            return done
        taken = taken.unionByName(now.select("core"))


def _shuffled(key: str, letters: str) -> str:
    """The letters in an order that the key decides."""
    return "".join(sorted(letters, key=lambda c: hashlib.sha256(f"{key}\x1f{c}".encode()).digest()))


def _spelled() -> str:
    """The surrogate core in the spelling of value."""
    digits_before = "length(regexp_replace(substring(value, 1, i), '[^0-9]', ''))"
    digits = "replace(core, '+', '')"
    in_places = f"array_join(transform(sequence(0, length(value) - 1), i -> IF(substring(value, i + 1, 1) RLIKE '[0-9]', substring({digits}, {digits_before} + 1, 1), substring(value, i + 1, 1))), '')"
    in_places = f"concat({in_places}, substring({digits}, 1 + length(regexp_replace(value, '[^0-9]', ''))))"
    letters_before = "length(replace(substring(value, 1, i), ' ', ''))"
    grouped = f"array_join(transform(sequence(0, length(value) - 1), i -> IF(substring(value, i + 1, 1) = ' ', ' ', substring(core, {letters_before} + 1, 1))), '')"
    grouped = f"concat({grouped}, substring(core, 1 + length(replace(value, ' ', ''))))"
    cased = "IF(length(value) > 1 AND value = upper(value), upper(core), array_join(transform(split(core, '-'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '-'))"
    return f"""CASE kind WHEN 'ip' THEN core
      WHEN 'ip6' THEN IF(value = upper(value), upper(core), core)
      WHEN 'email' THEN IF(value = upper(value), upper(core), core)
      WHEN 'secret' THEN IF(canon <> value AND value = upper(value), upper(core), core)
      WHEN 'iban' THEN {grouped}
      WHEN 'given' THEN {cased}
      WHEN 'surname' THEN {cased}
      ELSE {in_places} END"""


def _parts() -> str:
    """A match's entities in order, each with the text before it: a name's given name, initials and surname, else the value itself."""
    title = f"regexp_extract(whole, {_sql(_BARE)}, 0)"
    name = f"regexp_replace(whole, {_sql(_BARE)}, '')"
    form = f"^({_INITIALS})(?:({_WORD}) ({_INITIALS}))?({_PARTICLE})({_WORD})$"
    piece = lambda n: f"regexp_extract({name}, {_sql(form)}, {n})"
    init, given, more, particle, last = (piece(n) for n in range(1, 6))
    known = _list(" ".join(GIVEN.values()).lower())
    part = lambda kind, title, lead, value: f"named_struct('kind', {kind}, 'title', {title}, 'lead', {lead}, 'value', {value})"
    behind = f"IF({init} = '', {title}, '')"
    in_name = [
        part("'initials'", "''", title, init),
        part("'given'", title, behind, given),
        part("'initials'", "''", "' '", more),
        part(f"IF({given} = '' AND array_contains({known}, lower({last})), 'given', 'surname')", title, f"concat(CASE WHEN {given} = '' THEN {behind} WHEN {more} = '' THEN ' ' ELSE '' END, {particle})", last),
    ]
    return f"CASE WHEN kind <> 'name' THEN array({part('kind', _sql(''), _sql(''), 'whole')}) ELSE filter(array({', '.join(in_name)}), p -> p.value <> '') END"


def _matches(rows: DataFrame, pattern: str) -> DataFrame:
    """k, id, at, whole, lead (the text before it), tail (the text behind it) of each match of a text."""
    found = rows.select("k", "id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("wholes"), "text").where("size(wholes) > 0")
    between = F.split("text", pattern, -1)
    each = F.transform(F.sequence(F.lit(0), F.size("wholes") - 1), lambda i: F.struct(F.get("wholes", i).alias("whole"), F.get("between", i).alias("lead"), F.get("between", i + 1).alias("tail")))
    return found.withColumn("between", between).select("k", "id", F.posexplode(each).alias("at", "m")).select("k", "id", "at", "m.*").dropDuplicates(["k", "id", "at"])


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """k, id, at, kind, whole of all capitalised words and matches of the texts that hold names; found has surnames by text.

    A word's kind is surname if the text has that surname in a full name; given if it
    stands right before one in mid-sentence, or is a given name of the text elsewhere;
    else it is null, and the word stays.
    """
    parts = found.select("k", "id", F.explode("parts").alias("p")).select("k", "id", "p.kind", F.lower("p.value").alias("canon"))
    own = cut(parts.where("kind IN ('given', 'surname')").distinct())
    givens, own = own.where("kind = 'given'").drop("kind"), own.where("kind = 'surname'").drop("kind")
    texts = found.select("k", "id").distinct()
    held = rows.join(small(cut(texts.select("k").distinct())), "k", "left_semi").alias("r")
    held = held.join(texts.alias("t"), (F.col("t.k") == F.col("r.k")) & F.col("t.id").eqNullSafe(F.col("r.id")), "left_semi")
    words = cut(_matches(held, WIDE).withColumn("kind", type_of(F.col("whole"))))
    w, o = words.alias("w"), own.alias("o")
    same = (F.col("o.k") == F.col("w.k")) & F.col("o.id").eqNullSafe(F.col("w.id")) & (F.col("o.canon") == F.lower("w.whole")) & F.col("w.kind").isNull()
    told = w.join(o, same, "left").select("w.*", F.col("o.canon").isNotNull().alias("is_surname"))
    before_one = F.lead("is_surname").over(Window.partitionBy("k", "id").orderBy("at"))
    given = before_one & (F.col("tail") == " ") & F.col("lead").rlike(r"[\p{Ll},] $") & ~F.col("whole").isin((" ".join(HONORIFICS.values())).split())
    kind = F.coalesce("kind", F.when(F.col("is_surname"), "surname").when(given, "given"))
    told = cut(told.select("k", "id", "at", kind.alias("kind"), "whole"))
    givens = cut(givens.unionByName(told.where("kind = 'given'").select("k", "id", F.lower("whole").alias("canon"))).distinct()).alias("g")
    t = told.alias("t")
    again = (F.col("g.k") == F.col("t.k")) & F.col("g.id").eqNullSafe(F.col("t.id")) & (F.col("g.canon") == F.lower("t.whole")) & F.col("t.kind").isNull()
    return t.join(givens, again, "left").select("t.k", "t.id", "t.at", F.coalesce("t.kind", F.when(F.col("g.canon").isNotNull(), "given")).alias("kind"), "t.whole")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities (replaced stretches), kinds (sorted) for every row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("k", F.xxhash64("id", "text"))
    found = rows.select("k", "id", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("at", "whole")).dropDuplicates(["k", "id", "at"])
    found = cut(found.withColumn("kind", type_of(F.col("whole"))).withColumn("parts", F.expr(_parts())).withColumn("wide", F.lit(False)))
    named = found.where("kind = 'name'")
    if not named.isEmpty():
        wide = _named(rows, named).withColumn("parts", F.when(F.col("kind").isNotNull(), F.expr(_parts())))
        wide = cut(wide.withColumn("wide", F.lit(True)))
        w, f = wide.select("k", "id").distinct().alias("w"), found.alias("f")
        rest = f.join(w, (F.col("w.k") == F.col("f.k")) & F.col("w.id").eqNullSafe(F.col("f.id")), "left_anti")
        found = rest.select("f.*").unionByName(wide)
    of_match = found.where("kind IS NOT NULL").select("kind", "whole", "parts").groupBy("kind", "whole").agg(F.first("parts").alias("parts"))
    values = of_match.select(F.col("kind").alias("of"), "whole", F.posexplode("parts").alias("n", "p")).select("of", "whole", "n", "p.*")
    values = cut(values.select("of", "whole", "n", "kind", "title", "lead", "value", F.expr(CANON).alias("canon"), F.expr(SCRIPT).alias("script"), F.expr(_gender()).alias("gender")))
    entities = cut(values.where("kind <> 'initials'").groupBy("kind", "canon").agg(F.min("script").alias("script"), F.max("gender").alias("gender")))
    entity = values.join(surrogates(entities, key), ["kind", "canon"]).withColumn("stands", F.expr(_spelled()))
    initials = values.where("kind = 'initials'").withColumn("stands", F.translate("value", "".join(CAPITALS), "".join(_shuffled(key, x) for x in CAPITALS)))
    spelled = entity.select("of", "whole", "n", "lead", "stands").unionByName(initials.select("of", "whole", "n", "lead", "stands")).select("of", "whole", F.struct("n", F.concat("lead", "stands").alias("text")).alias("part"))
    spelled = cut(spelled.groupBy("of", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "").alias("stand")))

    stands = found.join(spelled.withColumnRenamed("of", "kind"), ["kind", "whole"], "left").select("k", "id", "at", "kind", "wide", F.coalesce("stand", "whole").alias("stand"))
    what = F.when(F.col("kind").isin("given", "surname"), "name").otherwise(F.col("kind"))
    in_docs = stands.groupBy("k", "id").agg(F.array_sort(F.collect_list(F.struct("at", "stand"))).alias("stands"), F.array_sort(F.collect_set(what)).alias("kinds"), F.count("kind").alias("n_entities"), F.max("wide").alias("wide"))
    in_docs = cut(in_docs)
    touched = small(cut(in_docs.select("k").distinct()))
    t, d = rows.join(touched, "k", "left_semi").alias("t"), in_docs.alias("d")
    both = t.join(d, (F.col("t.k") == F.col("d.k")) & F.col("t.id").eqNullSafe(F.col("d.id"))).select("t.id", "t.text", "d.stands", "d.kinds", "d.n_entities", "d.wide")
    between = F.when(F.col("wide"), F.split("text", WIDE, -1)).otherwise(F.split("text", ANY, -1))
    woven = F.array_join(F.zip_with(between, F.concat(F.transform("stands", lambda s: s["stand"]), F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    changed = both.select(F.col("id").alias("doc_id"), woven.alias("text"), "n_entities", "kinds")
    same = rows.join(touched, "k", "left_anti").select(F.col("id").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)
