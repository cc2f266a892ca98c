"""Keyed surrogates for personal data, with built-in functions only.

Detection is one regular expression per type; a mention's *canonical form*
(lower-case address, digits of a number) makes different spellings of one
entity the same.  A surrogate is drawn from a keyed digest stream of type,
canonical form and attempt, and rendered in the mention's own format: digits
for digits, letters of the same script and case, separators where they were;
card numbers keep their issuer digit and a valid check digit if they had one;
addresses keep their top-level domain; names keep title, gender and script.

Names are found by their titles.  Given and family names are entities of their
own, each with its surrogate, so "Mr. John Smith", "Mr. Smith" and, in a text
that has one of them, "John Smith", "Smith" and "John" stay one person.

Equal entities get equal surrogates wherever they occur.  That different ones
stay different, and that no surrogate is an entity of the input (given names:
not the one it replaces), is checked over all distinct entities: of those that
collide, the first by canonical form stays and the others draw again, until
none collides.  Every `WIDEN` attempts the format grows by a character, a
syllable or a second given name, so no space is ever exhausted.  Only the
attempts above 0 have to reach the documents; they are a small table, given as
a literal up to `literal_rows` and joined per document beyond.

Defined results: null texts stay null, empty ones empty; texts without digits,
'@', a key's prefix, 32 hexadecimal letters or a title are passed through unread by the detectors; repeated rows are
treated alike; other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, fresh

# Titles by gender, given names by script and gender, syllables of family names by script.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|Госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|г-н|Господин"
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Greta Helena Ida Julia Laura Maria Nina Olivia Paula Rosa Sofia Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Oscar Paul Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён Юрий".split(),
}
SYLLABLES = {
    "latin": "bar cor dan fel gar hol kes lam mon ner pol ris sten tor val wen".split(),
    "cyrillic": "бар вол гор дан зар кол лам мир нов пол рам сан тар фил хол шат".split(),
}
LUHN = r"(?<![\p{L}\d.-])\d(?:[ -]?\d){12,18}(?![\p{L}\d]|[.-]\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,256}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb)[-_][A-Za-z0-9_-]{16,}+)(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"(?<![\p{L}\d+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d+.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\p{L}\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d|[.-]\d)",
    "card": LUHN,
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}(?:\p{{L}}|['’-](?=\p{{Lu}})){{1,40}}(?: \p{{Lu}}(?:\p{{L}}|['’-](?=\p{{Lu}})){{1,40}})?",
}
ORDER = ("email", "iban", "secret", "ip", "ssn", "phone", "card", "name")
ANY = "|".join(f"(?:{PATTERNS[t]})" for t in ORDER)
HINT = rf"[\d@]|AKIA|(?:sk|pk|ghp|gho|xoxb)[-_]|[0-9a-f]{{32}}|[0-9A-F]{{32}}|(?<!\p{{L}})(?:{FEMALE}|{MALE})\b"
ALNUM = r"[^\p{L}\p{N}]"
WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{Lu})){1,40}"  # what a detected name may be without its title
WORDS = rf"{ANY}|(?<!\p{{L}}){WORD}(?!\p{{L}})"
TITLE = rf"\A((?:{FEMALE}|{MALE})\.? )"
MARK = "\ufdd0"  # a noncharacter, set around mentions
WIDEN = 3


def kind_of(m: Column) -> Column:
    """Type of a mention: the first whose pattern matches all of it."""
    # looked at by itself a mention has nothing around it, so the patterns' own lookarounds hold
    out = F.lit(None).cast("string")
    for t in reversed(ORDER):
        out = F.when(F.rlike(m, F.lit(rf"\A(?:{PATTERNS[t]})\z")), F.lit(t)).otherwise(out)
    return out


def canonical(m: Column, kind: Column) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    return F.when(kind == "email", F.lower(m)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind.isin("family", "f", "m"), F.lower(m)).otherwise(m)


def _stream(key: str, kind: Column, canon: Column, attempt: Column, chars: Column) -> Column:
    """Hexadecimal digits, four for each character to be drawn and 32 more."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), F.ceil((chars * 4 + 32) / 128).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 512)), "")


def _draw(stream: Column, at: Column, n: Column) -> Column:
    """The at-th number below n of a stream."""
    return F.pmod(F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int"), n)


def _letters(first: str, n: int, step: int = 1) -> str:
    return "".join(chr(ord(first) + step * i) for i in range(n))


# classes of characters that stand in for each other: digit, script and case stay
CLASSES = [
    ("[0-9]", _letters("0", 10)),
    ("[a-z]", _letters("a", 26)),
    ("[A-Z]", _letters("A", 26)),
    (r"[\p{IsLatin}&&\p{Ll}]", "áàâäãåçéèêëíìîïñóòôöõúùûüý"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", _letters("а", 32)),
    (r"[\p{IsCyrillic}&&\p{Lu}]", _letters("А", 32)),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", _letters(chr(0x4E00), 200, 37)),
    (r"[\p{IsKatakana}\p{IsHiragana}]", _letters(chr(0x30A2), 80)),
]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _mapped(m: Column, stream: Column, only: Column) -> Column:
    """m with every letter and digit drawn anew, from `only` where that is not
    null; the k-th takes the k-th number of the stream."""

    def one(i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), ALNUM, ""))

        def among(c: Column) -> Column:
            kinds = F.lit(None).cast("string")
            for pattern, letters in reversed(CLASSES):
                kinds = F.when(F.rlike(c, F.lit(pattern)), F.coalesce(only, F.lit(letters))).otherwise(kinds)
            return _let(kinds, lambda letters: F.when(letters.isNull(), c).otherwise(F.substring(letters, _draw(stream, at, F.length(letters)) + 1, F.lit(1))))

        return _let(F.substring(m, i, F.lit(1)), among)

    return F.when(F.length(m) == 0, m).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), ""))


def _luhn_sum(digits: Column) -> Column:
    """Sum by the Luhn rule of digits that a check digit is to follow."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        two = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)


def _last_digit(text: Column, digit: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), digit.cast("string"))


def _checked(m: Column, made: Column) -> Column:
    """made with a last digit that is valid by the Luhn rule, if m's is."""

    def check(d: Column) -> Column:
        return F.pmod(10 - F.pmod(_luhn_sum(F.substring(d, F.lit(1), F.length(d) - 1)), F.lit(10)), F.lit(10))

    digits = lambda x: F.regexp_replace(x, r"\D", "")
    valid = _let(digits(m), lambda d: check(d) == F.substring(d, F.length(d), F.lit(1)).cast("int"))
    return F.when(valid, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), _let(digits(made), check).cast("string"))).otherwise(made)


def _cyrillic(part: Column) -> Column:
    return F.rlike(part, F.lit(r"\p{IsCyrillic}"))


def _name_part(part: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a given name (kind f or m) or of a family name."""
    literal = lambda xs: F.array(*map(F.lit, xs))
    cyrillic, female = _cyrillic(part), kind == "f"
    more = F.floor(attempt / WIDEN).cast("int")
    given = F.when(cyrillic & female, literal(GIVEN["cyrillic", "f"])).when(cyrillic, literal(GIVEN["cyrillic", "m"])).when(female, literal(GIVEN["latin", "f"])).otherwise(literal(GIVEN["latin", "m"]))
    syllables = F.when(cyrillic, literal(SYLLABLES["cyrillic"])).otherwise(literal(SYLLABLES["latin"]))
    ending = F.when(~cyrillic, F.lit("")).when(F.rlike(F.lower(part), F.lit("а\\z")), F.lit("ова")).otherwise(F.lit("ов"))

    def made(stream: Column) -> Column:
        def drawn(xs: Column, n: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at(xs, _draw(stream, k, F.size(xs)) + 1))

        first = F.array_join(drawn(given, more + 1), "-")
        family = F.initcap(F.concat(F.array_join(drawn(syllables, more + 5), ""), ending))
        return F.when(kind == "family", family).otherwise(first)

    whole = _let(_stream(key, kind, F.lower(part), attempt, more + 5), made)
    return F.when((part == F.upper(part)) & (F.length(part) > 2), F.upper(whole)).otherwise(whole)


def _mention(m: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a mention that is no name."""
    # kept at the front: country code, issuer digit, key prefix; at the end: top-level domain
    front = F.when(kind == "phone", F.regexp_extract(m, r"\A(\+\d+)", 1)).when(kind == "card", F.substring(m, F.lit(1), F.lit(1))).when(kind.isin("secret", "iban"), F.regexp_extract(m, r"\A(AKIA|[a-z]{2,4}[-_]|[A-Z]{2}(?![0-9A-F]+\z))", 1)).otherwise(F.lit(""))
    end = F.when(kind == "email", F.regexp_extract(m, r"(\.[^.]*)\z", 1)).otherwise(F.lit(""))
    hexed = F.when(kind == "secret", F.when(F.rlike(m, F.lit(r"\A[0-9a-f]+\z")), F.lit("0123456789abcdef")).when(F.rlike(m, F.lit(r"\A[0-9A-F]+\z")), F.lit("0123456789ABCDEF")))
    more = F.floor(attempt / WIDEN).cast("int")

    def made(stream: Column) -> Column:
        middle = lambda a: _let(end, lambda z: F.concat(a, _mapped(F.substring(m, F.length(a) + 1, F.length(m) - F.length(a) - F.length(z)), stream, hexed), z))
        octets = F.array_join(F.transform(F.concat(F.split(m, r"\."), F.array_repeat(F.lit(""), more)), lambda _, i: (1 + _draw(stream, i, F.lit(254))).cast("string")), ".")

        def grown(x: Column, letters: str) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), more), lambda k: F.substring(F.lit(letters), _draw(stream, x + k, F.lit(len(letters))) + 1, F.lit(1))), "")

        def wide(x: Column) -> Column:
            longer = F.when(kind == "email", F.concat(grown(F.length(m), CLASSES[1][1]), x)).otherwise(F.concat(x, grown(F.length(m), CLASSES[0][1])))
            return F.when(more > 0, longer).otherwise(x)

        return F.when(kind == "ip", octets).otherwise(_let(_let(_let(front, middle), wide), lambda x: F.when(kind == "card", _checked(m, x)).otherwise(x)))

    return _let(_stream(key, kind, canonical(m, kind), attempt, F.length(m) + more), made)


def surrogate(m: Column, kind: Column, attempt: Column, key: str) -> Column:
    """What a mention, or a part of a name, is replaced with."""
    return F.when(kind.isin("family", "f", "m"), _name_part(m, kind, attempt, key)).otherwise(_mention(m, kind, attempt, key))


def pieces(text: Column, pattern: str) -> Column:
    """array<string>: by turns what lies between matches, and the matches."""
    split = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    # a text that holds the mark itself is read twice
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    twice = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(split)


def _odd(xs: Column) -> Column:
    return F.filter(xs, lambda _, i: F.pmod(i, F.lit(2)) == 1)


def _parts(m: Column) -> Column:
    """array<struct<kind, part>>: a titled name's family name and given name."""
    female = F.rlike(m, F.lit(rf"\A(?:{FEMALE})\.? "))

    def of(words: Column) -> Column:
        family = F.struct(F.lit("family").alias("kind"), F.element_at(words, -1).alias("part"))
        given = F.struct(F.when(female, F.lit("f")).otherwise(F.lit("m")).alias("kind"), words[0].alias("part"))
        return F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))

    return _let(F.split(F.regexp_replace(m, TITLE, ""), " "), of)


def mentions(text: Column) -> Column:
    """array<string> of all mentions by themselves, in order."""
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def entities(df: DataFrame, text_col: str) -> DataFrame:
    """kind, canon: the distinct entities of all texts, each with one mention of it."""
    found = df.select(F.explode(F.array_distinct(mentions(df[text_col].cast("string")))).alias("m")).distinct()
    found = found.withColumn("kind", kind_of(F.col("m")))
    own = F.array(F.struct(F.col("kind").alias("kind"), F.col("m").alias("part")))
    found = found.select(F.explode(F.when(F.col("kind") == "name", _parts(F.col("m"))).otherwise(own)).alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.part").alias("m"))
    return found.withColumn("canon", canonical(F.col("m"), F.col("kind"))).groupBy("kind", "canon").agg(F.min("m").alias("m"))


def settle(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt (above 0 only): which entities had to draw again.

    An entity's canonical surrogate must be no other's, and no entity itself
    (a given name's: not itself).  Those that fail draw again and are held
    against all entities and all surrogates settled so far."""
    found = cut(found, "pii")
    real = found.select("kind", F.col("canon").alias("s")).where("kind not in ('f', 'm')")
    drawn = lambda rows: rows.withColumn("s", canonical(surrogate(F.col("m"), F.col("kind"), F.col("attempt"), key), F.col("kind")))
    todo, used, out = found.withColumn("attempt", F.lit(0)), [real], []
    while True:
        rows = cut(drawn(todo), "pii")
        # on one surrogate meet few entities: its space is far larger than a group
        first = F.row_number().over(Window.partitionBy("kind", "s").orderBy("canon")) == 1
        # what is used is there once; few candidates are sent to it
        taken = reduce(DataFrame.union, used).join(rows.select("kind", "s").distinct(), ["kind", "s"]).withColumn("taken", F.lit(True))
        judged = rows.join(taken, ["kind", "s"], "left").withColumn("ok", first & F.col("taken").isNull() & (F.col("s") != F.col("canon")))
        judged = cut(judged.select("kind", "canon", "m", "attempt", "s", "ok"), "pii")
        drop(rows)
        used.append(judged.where("ok").select("kind", "s"))
        out.append(judged.where("ok and attempt > 0").select("kind", "canon", "attempt"))
        todo = judged.where("not ok")
        if todo.isEmpty():
            return reduce(DataFrame.union, out)
        todo = todo.select("kind", "canon", "m", (F.col("attempt") + 1).alias("attempt"))


def replace(df: DataFrame, text_col: str = "text", *, key: str, literal_rows: int = 200, found_col: str | None = None) -> DataFrame:
    """df with surrogates in text_col; found_col, if given, gets array<struct<kind, mention, surrogate>>."""
    again = settle(entities(df, text_col), key)
    few = again.limit(literal_rows + 1).collect()
    text, out = df[text_col].cast("string"), list(df.columns)
    name = lambda kind, canon: F.concat_ws("\x1f", kind, canon)
    (more,) = fresh(df, "__attempts__")
    if len(few) <= literal_rows:
        lookup = F.create_map(*(x for r in few for x in (F.lit(f"{r['kind']}\x1f{r['canon']}"), F.lit(r["attempt"])))) if few else None
        rows = df
    else:
        h = F.sha2(text, 256)
        each = df.select(h.alias("h"), F.explode(F.array_distinct(mentions(text))).alias("m")).distinct()
        each = each.withColumn("kind", kind_of(F.col("m")))
        own = F.array(F.struct(F.col("kind").alias("kind"), F.col("m").alias("part")))
        each = each.select("h", F.explode(F.when(F.col("kind") == "name", _parts(F.col("m"))).otherwise(own)).alias("x"))
        each = each.select("h", F.col("x.kind").alias("kind"), canonical(F.col("x.part"), F.col("x.kind")).alias("canon"))
        per = each.join(again, ["kind", "canon"]).groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(name(F.col("kind"), F.col("canon")), "attempt"))).alias(more))
        rows = df.join(per, h == per["h"], "left").drop(per["h"])
        lookup = F.col(more)

    def attempt(m: Column, kind: Column) -> Column:
        return F.lit(0) if lookup is None else F.coalesce(F.try_element_at(lookup, name(kind, canonical(m, kind))), F.lit(0))

    def named(m: Column, parts: Column) -> Column:
        made = F.transform(parts, lambda x: _name_part(x["part"], x["kind"], attempt(x["part"], x["kind"]), key))
        return F.concat(F.regexp_extract(m, TITLE, 1), F.array_join(made, " "))

    def one(known: Column):
        """The replacement of a match; a word that is no mention has none."""

        def found(m: Column) -> Column:
            # a word that a detected name of this text has, as a family name if it is one
            same = F.filter(known, lambda x: x["part"] == m)
            as_known = F.when(F.exists(same, lambda x: x["kind"] == "family"), F.lit("family")).otherwise(F.get(same, F.lit(0))["kind"])
            word = F.rlike(m, F.lit(rf"\A{WORD}\z"))

            def with_kind(kind: Column) -> Column:
                parts = F.when(word, F.array(F.struct(as_known.alias("kind"), m.alias("part")))).otherwise(_parts(m))
                made = F.when(kind == "name", named(m, parts)).otherwise(_mention(m, kind, attempt(m, kind), key))
                return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), m.alias("mention"), made.alias("surrogate")))

            # no pattern but that of secrets takes words of letters, and no short ones
            kind = F.when(word & (F.length(m) < 20), F.when(as_known.isNotNull(), F.lit("name"))).otherwise(F.coalesce(kind_of(m), F.when(word & as_known.isNotNull(), F.lit("name"))))
            return _let(kind, with_kind)

        return found

    tmp, cuts, names = fresh(rows, "__found__", "__cuts__", "__names__")
    none = F.array().cast("array<struct<kind:string,part:string>>")
    rows = rows.withColumn(cuts, F.when(F.rlike(text, F.lit(HINT)), pieces(text, ANY)))
    titled = F.filter(_odd(F.col(cuts)), lambda m: F.rlike(m, F.lit(TITLE)))
    rows = rows.withColumn(names, F.coalesce(F.array_distinct(F.flatten(F.transform(titled, lambda m: _parts(m)))), none))
    rows = rows.withColumn(cuts, F.when(F.size(names) > 0, pieces(text, WORDS)).otherwise(F.col(cuts)))
    rows = rows.withColumn(tmp, F.transform(_odd(F.col(cuts)), one(F.col(names))))
    even = F.filter(F.col(cuts), lambda _, i: F.pmod(i, F.lit(2)) == 0)
    matches = F.zip_with(_odd(F.col(cuts)), F.col(tmp), lambda m, x: F.coalesce(x["surrogate"], m))
    joined = F.array_join(F.flatten(F.zip_with(even, matches, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    found = F.coalesce(F.filter(tmp, lambda x: x.isNotNull()), F.array().cast("array<struct<kind:string,mention:string,surrogate:string>>"))
    rows = rows.withColumn(text_col, F.when(F.size(tmp) > 0, joined).otherwise(text))
    return rows.select(*(F.col(f"`{c}`") for c in out), *([found.alias(found_col)] if found_col else []))


def report(documents: DataFrame, key: str) -> DataFrame:
    """doc_id, number of mentions, their types, and the text with surrogates."""
    out = replace(documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")), key=key, found_col="found")
    return out.select("doc_id", F.size("found").cast("long").alias("n_mentions"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",").alias("kinds"), "text")
