"""Operator 1, secret scans: candidates by pattern, and a random forest that removes false positives.

A candidate is
- a value set for a secret word with = or : or in a tag of that name, to its closing quote or to white space, after any
  white space, a line's end included (a value on the next line isn't taken if it is the name of another setting);
- what follows a secret word after blanks (and "is"), if it holds a digit;
- a password in a URL;
- what begins like a known kind of key, of KEY_LEAST characters or more;
- a block of a private key, from its first line to its last;
- a run of letters, digits and _+/- (inside it .!@#$% too, and up to two = after it) that holds a digit, of MIXED_LEAST or
  more characters with a letter, of LEAST or more without.
Values have no least length. A text is gone through once: matches are marked where they lie, and split off at the marks.

The forest sees a candidate's length, the transitions between its characters (changes of class, how probable its pairs of
letters are), how much of it a dictionary covers, the path of its document and the words beside it. Dictionary and
probabilities are counted over the words of all documents (learn). It is trained from labelled findings (columns
candidate, before, after, path, label); without any given, from example_findings(), which are made by rule.

All of it is DataFrame expressions and Spark's own random forest; no candidate leaves its row, so nothing but the counts of
words is shuffled. The finding's own text is not in the result of scan(), only its digest.

Defined results: null and empty texts have no candidates; a null doc_id or path is passed on, and a null path has no
features; equal candidates of a text are separate findings, told apart by nth; very long texts are scanned whole; other
columns are ignored; an empty table gives no rows. redact() changes nothing but the findings.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, narrow

LEAST, MIXED_LEAST, KEY_LEAST = 12, 8, 8


def listed(pattern: str) -> str:
    """A pattern whose character classes name each character: Java then looks it up in a table, and tests no ranges."""

    def one(m: re.Match) -> str:
        signs = re.findall(r"\\.|.", m[2], re.DOTALL)
        value = lambda c: {"t": "\t", "r": "\r", "n": "\n"}.get(c[1:], c[1:]) if c[0] == "\\" else c
        out: list[str] = []
        while signs:
            c = signs.pop(0)
            if c == "\\s":
                out += " \t\n\x0b\f\r"
            elif len(signs) > 1 and signs[0] == "-":
                out += map(chr, range(ord(value(c)), ord(value(signs[1])) + 1))
                del signs[:2]
            else:
                out.append(value(c))
        return f"[{m[1]}" + "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in dict.fromkeys(out)) + "]"

    return re.sub(r"(?<!\\)\[(\^?)((?:\\.|[^\]\\])+)\]", one, pattern)


#: What a secret is named by; in names of several words the last ones.
_WORD = (
    r"(?:passw(?:or)?d|passphrase|passcode|passwort|kennwort|pwd|senha|contrasena|secret|token|credentials?|bearer|(?:api|access|secret|private)[_.-]?key|authorization"
    r"|(?<![A-Za-z])(?:auth|key|private|pass|clave)|(?-i:Key|Auth|Pass))s?(?:[_.-]?[0-9]++|[_.-](?:base|value|text|prod|production|dev|test|live|staging|string))?"
)
_OTHER_WORD = "(?:contraseña|mot de passe|hasło|пароль|密码|密碼|パスワード|비밀번호)"
_SIGN = r"[\"'`\])}\\]*+\s*+(?:[=:]++>?|>)"
_BESIDE = r"(?:[ \t]*+(?=\S)|\s*+(?![A-Za-z0-9_.-]++[\"'`]?\s*+[=:](?!//)))"
_OPENS = r"(?:(?i:bearer|basic)[ \t]++)?\\?[\"'`]?"
_RUN, _ALL = "[A-Za-z0-9_+/-]", "[A-Za-z0-9_+/.!@#$%-]"
#: What stands before a value: of a setting, after blanks, in a URL.
SETTING = rf"(?:{_ALL}*?(?i:{_WORD})|{_OTHER_WORD}){_SIGN}{_BESIDE}{_OPENS}"
_BLANK = rf"(?i:[ \t]++(?:is|was|ist|est))?[ \t]++{_OPENS}"
BLANKS = rf"{_ALL}*?(?i:{_WORD}){_BLANK}"
_DIGIT_AHEAD = r"(?=[^\s\"'`<>0-9]*+[0-9])"
URL = r"[A-Za-z][A-Za-z0-9+.-]*+://[^\s/@:\"'<>]*+:"
#: Beginnings of keys, with what follows them.
KEYS = r"(?:(?:AKIA|ASIA)[A-Z0-9]+|(?:gh[opusr]_|github_pat_|hf_|npm_|sk[_-]|xox[a-z]-|AIza|glpat-)[A-Za-z0-9_-]*[A-Za-z0-9]|(?:SG\.|eyJ|ya29\.)[A-Za-z0-9_.-]*[A-Za-z0-9_-])"
BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----[^-]*+(?:-[^-]++){0,64}+(?:-----END[^-\r\n]*+-----)?"
#: A quoted value ends before its quote, another one before white space, signs at a sentence's end, or the next setting of a list.
_QUOTED = "|".join([r'(?<=\\")[^"\\\r\n]+(?=\\")', *[rf"(?<={q})[^{q}\r\n]+?(?<!\\)(?={q})" for q in "\"'`"]])
_VALUE = rf"(?:{_QUOTED}|[^\s\"'`<>]+?(?=[.,;:)\]}}?]{{0,8}}(?:[\s\"'`<>]|\z)|[&,;][A-Za-z0-9_.-]{{1,40}}=))"
#: A match begins where a run does, or right after another match, so a run is gone through a fixed number of times.
#: Loops are over single characters, not groups, which would take the stack of a very long value.
PATTERN = listed(rf"(?:(?<!{_ALL})|\G)(?:" + "|".join(
    [
        BLOCK,
        rf"(?={_ALL}*+[\"'`\])}}\\]*+\s*+[=:>])(?:{URL}[^\s/\"'<>]+(?=@)|{SETTING}(?!(?i:bearer|basic)[ \t]){_VALUE})",
        rf"{_OTHER_WORD}{_SIGN}{_BESIDE}{_OPENS}{_VALUE}",
        rf"(?={_ALL}{{{KEY_LEAST}}}){_ALL}*?(?<![A-Za-z0-9]){KEYS}",
        rf"(?={_ALL}++{_BLANK}{_DIGIT_AHEAD}){BLANKS}{_DIGIT_AHEAD}{_VALUE}",
        rf"[.!@#$%]*+(?=[A-Za-z_+/.!@#$%-]*+[0-9])(?:(?=[0-9_+/.!@#$%-]*+[A-Za-z]){_RUN}{_ALL}{{{MIXED_LEAST - 2},}}{_RUN}={{0,2}}|{_RUN}{_ALL}{{{LEAST - 2},}}{_RUN}={{0,2}}|{_RUN}{{{LEAST - 2},}}={{1,2}})",
    ]
) + ")")
#: What marks a match's ends; a text that holds this noncharacter itself is gone through twice instead.
MARK = "\ufdd0"
#: Characters beside a candidate that the forest sees.
BESIDE = 48
THRESHOLD = 0.5
#: Pairs of letters of a run that are looked up at once, as a place is found from the beginning of what it lies in.
STRETCH = 128
TREES, DEPTH = 20, 6
#: Labelled findings that example_findings() makes: this bounds what is trained on.
FINDINGS = 3000

#: Words that candidates other than secrets are made of, beside those of the documents.
DICTIONARY = "access account address array backup base build cache chapter class client code commit config content copy count data date default demo description document download draft error event example false field file final font format group handler header height home http image index info input invoice item json lambda layer license line list local login main message method model module name node null number object order output page part path phone photo print project public query record report request response sample schema screen script section server session sheet size source start status string style system table target temp test text time title total true type unit update user utf value version video view web week width window".split()
SECRET_WORDS = "password passwd pwd secret token key apikey auth bearer credential credentials private access_key secret_key api_key".split()
NO_VALUES = "a an the is are be to of in it this that none null nil undefined true false yes no on off required optional int integer str bool boolean enabled disabled unknown missing invalid expired empty changed forgotten".split()
OTHER_WORDS = "commit sha sha1 md5 checksum digest hash etag uuid guid id version build isbn phone tel fax card order invoice ticket serial revision ref figure page".split()


def _parts(text: Column) -> Column:
    """A text's parts in turn: what lies between matches, and at odd places the matches."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    found, between = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    twice = F.flatten(F.transform(between, lambda x, i: F.filter(F.array(x, F.get(found, i)), lambda y: y.isNotNull())))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(marked)


def _ahead(match: Column) -> Column:
    """The characters of a match before its value."""
    head = F.length(F.regexp_extract(match, rf"^(?:{URL}|{SETTING}|{BLANKS})", 0))
    inside = F.length(F.regexp_extract(match, rf"^({_ALL}*?)(?<![A-Za-z0-9]){KEYS}\z", 1))
    bare = F.length(F.regexp_extract(match, r"^[.!@#$%]+(?=.)", 0))
    # A block's first line looks like words before a value.
    return F.when(match.startswith("-----BEGIN"), 0).when((head > 0) & (head < F.length(match)), head).when(inside > 0, inside).otherwise(bare)


def _split(text: Column, one) -> Column:
    """one(match, number, parts) of every match of a text. An array of one binds the parts."""
    number = lambda parts: F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    return F.get(F.transform(F.array(_parts(text)), lambda parts: F.transform(number(parts), lambda i: one(F.get(parts, i), F.floor(i / 2).cast("int"), parts))), F.lit(0))


def candidates(text: Column) -> Column:
    """Array of (candidate, before, after) of a text; white space before a candidate is folded."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def one(match, i, parts):
        bound = F.array(F.struct(match.alias("m"), _ahead(match).alias("n")))
        before = lambda x: F.regexp_replace(F.concat(F.right(F.get(parts, 2 * i), F.lit(BESIDE)), F.left(x["m"], x["n"])), r"\s+", " ")
        return F.get(F.transform(bound, lambda x: F.struct(F.substring(x["m"], x["n"] + 1, F.length(x["m"])).alias("candidate"), F.right(before(x), F.lit(BESIDE)).alias("before"), F.left(F.get(parts, 2 * i + 2), F.lit(BESIDE)).alias("after"))), F.lit(0))

    return _split(text, one)


@dataclass
class Language:
    """What documents' words are like: the commonest, and for each letter the logarithm to base 2 of how probable the next one is."""

    words: list[str]
    pairs: list[float]


def learn(docs: DataFrame, most: int = 2000) -> Language:
    """The commonest words of all documents, and the pairs of letters in all of them, each as often as it occurs.

    Words are counted where they lie and summed by word. The driver gets most words and 26 * 26 numbers.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(docs["text"].cast("string")), F.lit(listed("[a-z]{3,}")), F.lit(0))).alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    common = [r["word"] for r in counts.filter(F.length("word") <= 24).orderBy(F.desc("n"), "word").limit(most).collect()]
    runs = counts.select("n", F.explode(_stretches(F.col("word"))).alias("run"))
    at = F.explode(F.sequence(F.lit(1), F.length("run") - 1))
    pairs = runs.select("n", "run", at.alias("i")).groupBy(F.substring("run", F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))
    seen = {r["pair"]: r["n"] for r in pairs.collect()}
    return Language(common, _logs(seen))


def _logs(seen: dict[str, int]) -> list[float]:
    """Of each pair of letters, in their order; each is counted once more than it was seen."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for a in letters:
        total = sum(seen.get(a + b, 0) + 1 for b in letters)
        out += [math.log2((seen.get(a + b, 0) + 1) / total) for b in letters]
    return out


def built_in() -> Language:
    """The dictionary of this module alone."""
    return Language([], _logs(Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))))


def _constant(value, kind: str) -> Column:
    """A value as one literal of the plan, not as an expression of its parts."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _longest(words: set[str]) -> str:
    """A pattern of the longest of these words that begins at a place, by their first letters."""
    ahead: dict[str, set[str]] = {}
    for w in words - {""}:
        ahead.setdefault(w[0], set()).add(w[1:])
    branches = "|".join(a + _longest(rest) for a, rest in sorted(ahead.items()))
    return branches and f"(?:{branches})" + "?" * ("" in words)


def _covered(low: Column, language: Language) -> Column:
    """Characters of a text that lie in words of the dictionary: from left to right, the longest word at each place."""
    known = {w for w in (*DICTIONARY, *language.words) if re.fullmatch("[a-z]{3,}", w)}
    return F.length(low) - F.length(F.regexp_replace(low, F.lit(_longest(known)), F.lit("")))


def _stretches(low: Column) -> Column:
    """The runs of letters of a text, in stretches of STRETCH pairs of letters: each begins with the last letter of the one before."""
    return F.regexp_extract_all(low, F.lit(f"(?=([a-z]{{2,{STRETCH + 1}}}))[a-z]{{1,{STRETCH}}}"), F.lit(1))


def _probable(low: Column, language: Language) -> Column:
    """The mean logarithm of the probabilities of a text's pairs of letters; 0 if it has none."""
    logs = _constant(language.pairs, "array<double>")
    letter = lambda x, i: F.ascii(F.substring(x, i, F.lit(1))) - 97
    log = lambda x, i: F.get(logs, 26 * letter(x, i) + letter(x, i + 1))
    total = lambda own: F.aggregate(own, F.lit(0.0), lambda t, x: F.aggregate(F.sequence(F.lit(1), F.length(x) - 1), t, lambda u, i: u + log(x, i)))
    pairs = lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + F.length(x) - 1)
    return F.get(F.transform(F.array(_stretches(low)), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(total(own) / pairs(own))), F.lit(0))


def features(language: Language | None = None) -> dict[str, Column]:
    """What the forest sees, from the columns candidate, before, after and path; a candidate counts whole, however long it is."""
    language = language or built_in()
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern)) / n
    runs = c
    for letters, one in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^A-Za-z0-9]+", "-")):
        runs = F.regexp_replace(runs, letters, one)
    one_of = lambda words: "(?i)(?<![A-Za-z])(" + "|".join(words) + ")(?![A-Za-z])"
    before, after, path = (F.coalesce(F.col(x), F.lit("")) for x in ("before", "after", "path"))
    near = F.right(before, F.lit(20))
    flag = lambda x: x.cast("double")
    return {
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "other": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "changes": (F.length(runs) - 1) / n,
        "probable": _probable(low, language),
        "dictionary": _covered(low, language) / n,
        "hex": flag(c.rlike("^[0-9a-f]+$")),
        "grouped": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "all_digits": flag(c.rlike("^[0-9+/_.:$%#T-]+$")),
        "key_prefix": flag(c.rlike(f"^{KEYS}")),
        "special": share("[.!@#$%]"),
        "address": flag(c.rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$")),
        "name": flag(c.rlike(r"^[A-Za-z_][\w/-]*(\.[A-Za-z_][\w/-]*)+$")),
        "no_value": flag(low.rlike("^(" + "|".join(DICTIONARY + NO_VALUES) + r")$|^[^a-z0-9]*$|^(\$|%|\{|\[|\()")),
        "setting": flag(before.rlike(rf"(?:(?i:{_WORD})|{_OTHER_WORD}){_SIGN}\\s?{_OPENS}$")),
        "beside": flag(before.rlike(rf"{BLANKS}$")),
        "block": flag(c.startswith("-----BEGIN")),
        "url": flag(before.rlike(r"(//|^)[^\s/@:]*:$") & after.startswith("@")),
        "secret_word": flag(near.rlike(one_of(SECRET_WORDS))),
        "other_word": flag(near.rlike(one_of(OTHER_WORDS))),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "other_word_after": flag(F.left(after, F.lit(20)).rlike(one_of(OTHER_WORDS))),
        "path_test": flag(path.rlike("(?i)(test|example|sample|mock|fixture|docs?)([/_.]|$)")),
        "path_depth": F.size(F.split(path, "/")).cast("double"),
    }


def example_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings made by rule from digests of their number: secrets in their usual settings, and what resembles them."""
    i = F.col("id")
    base = spark.range(rows).select("id", F.concat(F.sha2(F.concat(F.lit("finding"), i.cast("string")), 256), F.sha2(F.concat(F.lit("more"), i.cast("string")), 256)).alias("h"))
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id"), F.lit(len(DICTIONARY))) + 1).cast("int"))
    other = lambda n: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    none = F.element_at(F.array(*map(F.lit, NO_VALUES)), (F.pmod(F.xxhash64("id"), F.lit(len(NO_VALUES))) + 1).cast("int"))
    base = cut(base.select("id", "h", F.regexp_replace(F.base64(F.unhex("h")), "[=\\s]", "").alias("b"), word.alias("word"), other(2).alias("word2"), other(3).alias("word3"), none.alias("nothing")), "finding-parts")
    h, b, word, word2, word3, nothing = map(F.col, ("h", "b", "word", "word2", "word3", "nothing"))
    cut_ = lambda x, n: F.substring(x, 1, n)
    digits = F.translate(h, "abcdef", "012345")
    plain = F.concat(F.lit("of "), word, F.lit(" the "), F.reverse(word), F.lit(" "))
    letters = F.regexp_replace(F.upper(b), "[^A-Z0-9]", "")
    lit = F.lit
    kinds = [  # candidate, before, after, path, label
        (cut_(h, 40), F.concat(plain, lit('token = "')), lit('" '), lit("src/app.py"), 1),
        (cut_(h, 18), F.concat(plain, lit("password=")), lit(" and"), lit("conf/settings.ini"), 1),
        (F.concat(lit("AKIA"), cut_(letters, 16)), plain, lit(" in"), lit("web"), 1),
        (cut_(b, 40), F.concat(plain, lit("secret_key: '")), lit("'\n"), lit("deploy/env.yml"), 1),
        (F.concat(lit("ghp_"), cut_(F.regexp_replace(b, "[+/]", "x"), 36)), plain, lit("\n"), lit("notes"), 1),
        (cut_(b, 24), F.concat(plain, lit("api_key=")), lit("\n"), lit("run.sh"), 1),
        (cut_(h, 32), F.concat(plain, lit("auth: ")), lit(" "), lit("web"), 1),
        (F.concat(lit("4"), cut_(digits, 15)), plain, lit(" the"), lit("web"), 0),
        (cut_(h, 40), F.concat(plain, lit("commit ")), lit("\n"), lit("web"), 0),
        (F.concat_ws("-", cut_(h, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.concat(plain, lit("id=")), lit(" "), lit("web"), 0),
        (cut_(h, 32), F.concat(plain, lit("md5: ")), lit(" checksum"), lit("docs/readme"), 0),
        (F.concat(word, lit("_"), F.reverse(word), lit("_"), cut_(digits, 2)), plain, lit(" "), lit("src/test/example.py"), 0),
        (F.concat(lit("2024-"), F.substring(digits, 1, 2), lit("-"), F.substring(digits, 3, 2), lit("T10")), plain, lit(":00"), lit("web"), 0),
        (F.concat(F.substring(digits, 1, 3), lit("-"), F.substring(digits, 4, 3), lit("-"), F.substring(digits, 7, 4)), F.concat(plain, lit("phone ")), lit(" "), lit("web"), 0),
        (F.concat(lit("/"), word, lit("/"), word, lit("/v"), F.substring(digits, 1, 1), lit("/"), F.reverse(word)), F.concat(plain, lit("https://example.com")), lit(" "), lit("web"), 0),
        (F.concat(word, F.initcap(F.reverse(word)), F.substring(digits, 1, 3)), F.concat(plain, lit("= ")), lit(" "), lit("src/sample/a.js"), 0),
        (cut_(digits, 14), F.concat(plain, lit("order ")), lit(" of"), lit("web"), 0),
        (F.concat(word, lit("token"), F.substring(digits, 1, 2)), F.concat(plain, lit("token = ")), lit(" "), lit("docs/example.md"), 0),
        (F.concat(lit("example"), word, lit("password1")), F.concat(plain, lit("password=")), lit(" "), lit("docs/sample.md"), 0),
        (F.concat(word, word2, F.substring(word3, 1, 6)), F.concat(plain, lit("password=")), lit("\n"), lit("web"), 1),
        (F.concat(F.reverse(word), word2), F.concat(plain, lit("passwd: ")), lit(" "), lit("web"), 1),
        (F.concat(F.initcap(word), lit("@"), cut_(digits, 3), lit("!"), F.substring(h, 5, 2)), F.concat(plain, lit('password = "')), lit('"'), lit("web"), 1),
        (F.concat(lit("P@"), F.reverse(word), lit("!"), cut_(digits, 4), lit("#"), F.substring(b, 1, 3)), plain, lit(" "), lit("web"), 1),
        (F.concat_ws(" ", word, word2, word3), F.concat(plain, lit("PASSWORD: '")), lit("'"), lit("web"), 1),
        (F.concat(word, cut_(digits, 4)), F.concat(plain, lit("api_key=")), lit("\n"), lit("web"), 1),
        (F.concat(word, cut_(digits, 2)), F.concat(plain, lit("password: ")), lit(" "), lit("web"), 1),
        (F.concat(lit("AKIA"), cut_(F.translate(letters, "0123456789", "QRSTUVWXYZ"), 16)), plain, lit(" in"), lit("web"), 1),
        (cut_(F.regexp_replace(b, "[+/]", "x"), 9), F.concat(plain, lit("postgres://admin:")), lit("@db.host/x"), lit("web"), 1),
        (F.concat(word, cut_(digits, 2)), F.concat(plain, lit("https://"), word2, lit(":")), lit("@example.com/"), lit("web"), 1),
        (F.concat(lit("SG."), cut_(F.regexp_replace(b, "[+/0-9]", "x"), 8), lit("."), F.substring(b, 20, 12)), plain, lit(" "), lit("web"), 1),
        (F.concat(lit("eyJ"), cut_(F.regexp_replace(b, "[+/]", "x"), 20), lit(".eyJ"), F.substring(h, 3, 20), lit("."), F.substring(h, 30, 20)), plain, lit(" "), lit("web"), 1),
        (word, F.concat(plain, lit("password: ")), lit(" and"), lit("web"), 0),
        (nothing, F.concat(plain, lit("token = ")), lit("\n"), lit("web"), 0),
        (nothing, F.concat(plain, lit("the key: ")), lit(" "), lit("web"), 0),
        (cut_(digits, 2), F.concat(plain, lit("key: ")), lit(" "), lit("web"), 0),
        (F.concat(lit("${"), F.upper(word), lit("}")), F.concat(plain, lit("password=")), lit("\n"), lit("web"), 0),
        (F.concat(word, lit("."), word2), F.concat(plain, lit("token = ")), lit("\n"), lit("web"), 0),
        (F.concat(word, lit("."), cut_(digits, 2), lit("@"), word2, F.substring(digits, 3, 1), lit(".com")), plain, lit(" "), lit("web"), 0),
        (F.concat_ws(".", *[F.substring(digits, n, 3) for n in (1, 4, 7, 10)]), plain, lit(" "), lit("web"), 0),
        (F.concat(lit("www."), word, cut_(digits, 2), lit(".example.com/"), word2, lit(".html")), F.concat(plain, lit("https://")), lit(" "), lit("web"), 0),
        (F.concat(lit("1."), cut_(digits, 1), lit(".0-beta."), F.substring(digits, 2, 2)), F.concat(plain, lit("version ")), lit(" "), lit("web"), 0),
        (F.concat(word, cut_(digits, 3)), F.concat(plain, lit("<password>")), lit("</password>"), lit("web"), 1),
        (cut_(F.regexp_replace(b, "[+/]", "x"), 10), F.concat(plain, lit("password = ")), lit("\n"), lit("web"), 1),
        (cut_(F.lower(F.regexp_replace(b, "[+/]", "x")), 10), F.concat(plain, lit("key ")), lit(" "), lit("web"), 1),
        (F.concat(word, cut_(digits, 2)), F.concat(plain, lit("the password is ")), lit(" "), lit("web"), 1),
        (F.concat(word, cut_(digits, 3), word2), F.concat(plain, lit("senha: ")), lit(" "), lit("web"), 1),
        (F.concat(lit("-----BEGIN RSA PRIVATE KEY-----\nMII"), cut_(b, 60), lit("\n-----END RSA PRIVATE KEY-----")), plain, lit("\n"), lit("web"), 1),
        (F.concat(lit("-----BEGIN PRIVATE KEY-----\n"), cut_(b, 64), lit("\n"), cut_(h, 40)), plain, lit("\n"), lit("web"), 1),
        (cut_(digits, 1), F.concat(plain, lit("key ")), lit(" of"), lit("web"), 0),
        (cut_(digits, 4), F.concat(plain, lit("token ")), lit(" in"), lit("web"), 0),
        (F.concat(word, cut_(digits, 1)), F.concat(plain, lit("token ")), lit(" "), lit("web"), 0),
        (F.concat(word, cut_(digits, 4)), plain, lit(" "), lit("web"), 0),
        (F.concat(cut_(digits, 2), lit("/"), F.substring(digits, 3, 2), lit("/20"), F.substring(digits, 5, 2)), plain, lit(" "), lit("web"), 0),
        (F.concat(F.substring(h, 1, 8)), F.concat(plain, lit("commit ")), lit(" "), lit("web"), 0),
        (F.concat(word, lit("-"), cut_(digits, 2), lit("-"), word2), plain, lit(" "), lit("web"), 0),
        (word, F.concat(plain, lit("<token>")), lit("</token>"), lit("web"), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    columns = [F.coalesce(*[F.when(kind == n, k[at].cast("string")) for n, k in enumerate(kinds)]) for at in range(4)]
    label = F.coalesce(*[F.when(kind == n, F.lit(float(k[4]))) for n, k in enumerate(kinds)])
    return base.select(*[c.alias(n) for c, n in zip(columns, ("candidate", "before", "after", "path"), strict=True)], label.alias("label"))


def with_features(findings: DataFrame, language: Language | None = None) -> DataFrame:
    """findings with the columns f (features, as Spark's classifiers take them)."""
    own = features(language)
    named = findings.select("*", *[x.alias(f"f_{n}") for n, x in own.items()])
    return VectorAssembler(inputCols=[f"f_{n}" for n in own], outputCol="f", handleInvalid="keep").transform(named).drop(*[f"f_{n}" for n in own])


@dataclass
class Scanner:
    """A forest, and the language that its features are made with."""

    forest: RandomForestClassificationModel
    language: Language | None = None


def train(findings: DataFrame, language: Language | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Scanner:
    known = cut(findings.select("candidate", "before", "after", "path", F.col("label").cast("double").alias("label")).filter("candidate is not null and label in (0, 1)"), "findings")
    seen = cut(with_features(known, language).select("f", "label"), "finding-features")
    return Scanner(RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(seen), language)


def scanner_for(docs: DataFrame) -> Scanner:
    """A scanner for documents: trained on the examples, with the documents' own words."""
    return train(example_findings(docs.sparkSession), learn(docs))


def findings_of(docs: DataFrame, scanner: Scanner, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, nth, candidate, before, after, path, score, is_secret of every candidate."""
    source = docs[path].cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), source.alias("path"))
    found = rows.select("doc_id", "path", F.xxhash64("text").alias("text_key"), F.posexplode(candidates(F.col("text"))).alias("nth", "x")).select("doc_id", "text_key", "nth", "x.*", "path")
    scored = scanner.forest.transform(with_features(found, scanner.language)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_key", "nth", "candidate", "before", "after", "path", "score", (F.col("score") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, nth (of the text's candidates), length, digest, score, is_secret of every candidate."""
    scanner = scanner or scanner_for(docs)
    return findings_of(docs, scanner).select("doc_id", F.col("nth").cast("bigint").alias("nth"), F.length("candidate").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("digest"), "score", "is_secret")


def redact(docs: DataFrame, scanner: Scanner | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mask; all other columns and rows as they were."""
    scanner = scanner or scanner_for(docs)
    secrets = cut(findings_of(docs, scanner).filter("is_secret").groupBy(F.col("doc_id").alias("secret_doc"), F.col("text_key").alias("secret_key")).agg(F.collect_set("nth").alias("secret_nths")), "secrets")
    found = narrow(secrets, secrets.agg(F.coalesce(F.sum(F.size("secret_nths") + 4), F.lit(0))).head()[0])
    text = docs["text"].cast("string")
    joined = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["secret_doc"]) & (F.xxhash64(text) == found["secret_key"]), "left")
    kept = _split(text, lambda m, i, parts: F.concat(F.get(parts, 2 * i), F.when(F.array_contains(found["secret_nths"], i), F.concat(F.left(m, _ahead(m)), F.lit(mask))).otherwise(m)))
    changed = F.concat(F.array_join(kept, ""), F.element_at(_parts(text), -1))
    return joined.select(*[F.when(found["secret_nths"].isNotNull(), changed).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns])
