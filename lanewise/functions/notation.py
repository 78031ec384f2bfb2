"""Column functions over notation strings and token arrays."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..presets import (BACKHAND, DEPTHS, DIRECTIONS, ENDING_MARKS, ERROR_LETTERS, FAULT_LETTERS, FOREHAND, NEUTRAL,
                       OTHER_MARKS, SERVE_DIGITS, SHOT_LETTERS, SHOTS)
from .pairing import edit_distances, edit_scripts


def char_class(chars: str) -> str:
    """A regex class of literal characters (safe in Java and RE2)."""
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def played(first: Column, second: Column) -> Column:
    """The string of the serve that was played: the second one when there is one."""
    return F.coalesce(blank_to_null(second), first)


def _let(c: Column, fn) -> Column:
    """fn of a column that is computed once, however often fn names it; a plain column is copied to each place."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def last_char(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.substring(c, -1, 1)).otherwise("")


def ending_type(p: Column) -> Column:
    """'*', an error kind n/w/d/x, or '?'."""
    last = F.right(F.rtrim(p, F.lit("@#!")), F.lit(1))
    return F.when(p.endswith("*"), "*").when(last.isin(*"nwdx"), last).otherwise("?")


def serve_token(p: Column) -> Column:
    head = F.substring(p, 1, 1)
    return F.concat(F.lit("s"), F.when(head.isin(*"456"), head).otherwise("?"))


_NEUTRAL_MARK = "\x01"                        # stands for a stroke of neither side, which prints as '?'


def _stroke_tokens(body: Column, shots: str) -> Column:
    """[side, direction] of each stroke: letters become their side, the rest goes but directions, and a side without one gets '?'.

    Whole-string functions only: a lambda over the strokes would be interpreted row by row."""
    sides = F.translate(body, FOREHAND + BACKHAND + NEUTRAL, "f" * len(FOREHAND) + "b" * len(BACKHAND) + _NEUTRAL_MARK * len(NEUTRAL))
    if "?" in shots:
        sides = F.translate(sides, "?", _NEUTRAL_MARK)
    full = F.regexp_replace(F.regexp_replace(sides, f"[^fb{_NEUTRAL_MARK}123]+", ""), f"([fb{_NEUTRAL_MARK}])(?![123])", "$1?")
    return F.regexp_extract_all(F.translate(full, _NEUTRAL_MARK, "?"), F.lit("[fb?][123?]"), F.lit(0))


def point_tokens(p: Column) -> Column:
    """[serve+zone] [letter+direction]* [ending] of a truth string."""
    return F.concat(F.array(serve_token(p)), _stroke_tokens(F.substring(p, 2, 1 << 30), SHOTS), F.array(ending_type(p)))


def draft_tokens(d: Column) -> Column:
    """The same for a draft string, where '?' is a legal stroke and the ending is peeled first."""
    def parts(core):
        last = F.right(core, F.lit(1))
        known = last.isin(*"*nwdx?")
        return F.struct(F.when(known, F.left(core, F.length(core) - 1)).otherwise(core).alias("body"), F.when(known, last).otherwise("?").alias("ending"))

    def tokens(s):
        return F.concat(F.array(serve_token(s["body"])), _stroke_tokens(F.substring(s["body"], 2, 1 << 30), SHOTS + "?"), F.array(s["ending"]))

    bare = _let(d, lambda d: F.rtrim(F.when(d.startswith("s"), F.substring(d, 2, 1 << 30)).otherwise(d), F.lit("@#!")))
    return _let(_let(bare, parts), tokens)


def token_kind(t: Column) -> Column:
    return (F.when((F.length(t) == 2) & t.startswith("s"), "serve")
            .when((F.length(t) == 1) & t.isin(*"*nwdx?"), "ending").otherwise("rally"))


def structural(tokens: Column) -> Column:
    """Serve as 's', rally as its letter, ending dropped."""
    kept = F.filter(tokens, lambda t: token_kind(t) != "ending")
    return F.transform(kept, lambda t: F.when(token_kind(t) == "serve", "s").otherwise(F.substring(t, 1, 1)))


def classify_sub(a: Column, b: Column) -> Column:
    """Which component of a substitution is wrong."""
    ka, kb = token_kind(a), token_kind(b)
    letter = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    direction = F.substring(a, 2, 1) == F.substring(b, 2, 1)
    return (F.when(ka != kb, "sub_crosstype").when(ka == "serve", "sub_serve_zone").when(ka == "ending", "sub_ending")
            .when(letter & ~direction, "sub_direction").when(direction & ~letter, "sub_letter").otherwise("sub_letter+dir"))


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance over the tokens of two arrays of any length; null where one is, null tokens count for nothing."""
    @F.arrow_udf("int")
    def distances(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(edit_distances(a, b), pa.int32())
    return distances(a, b)


def small_edit_distance(a: Column, b: Column, vocabulary: list[str]) -> Column:
    """The same; the vocabulary that callers name does not matter, tokens are numbered batch by batch."""
    return edit_distance(a, b)


NOTATION_TOKENS = ["s4", "s5", "s6", "s?", *[x + y for x in "fb?" for y in "123?"], "*", "n", "w", "d", "x", "?"]


def edit_ops():
    """Arrow UDF: (array<string>, array<string>) -> array of [op, a, b]."""
    @F.arrow_udf("array<array<string>>")
    def ops(a: pa.Array, b: pa.Array) -> pa.Array:
        return edit_scripts(a, b)
    return ops


def winner(first: Column, second: Column) -> Column:
    """1 = server, 2 = returner, null = cannot be derived."""
    f, s = F.trim(first), F.trim(second)
    return winner_of(s, F.when(s != "", s).otherwise(f))


def winner_of(s: Column, p: Column) -> Column:
    """The same from the trimmed second string and the played one. Both are named often: give columns that are computed once."""
    core = lambda c: F.rtrim(c, F.lit(OTHER_MARKS))
    double = (s != "") & last_char(core(s)).isin(*FAULT_LETTERS) & (F.translate(s, ENDING_MARKS, "") == s)
    rest = F.substring(p, 2, 1 << 30)
    strokes = F.length(rest) - F.length(F.translate(rest, SHOT_LETTERS, ""))
    hitter = F.when(strokes % 2 == 0, 1).otherwise(2)
    end = last_char(core(p))
    return F.when(double, 2).when(end == "*", hitter).when(end.isin("@", "#"), 3 - hitter)


def stroke_runs(p: Column) -> Column:
    """The strokes after the serve: each letter with what follows it."""
    cls = char_class(SHOTS)
    return F.regexp_extract_all(F.substring(p, 2, 1 << 30), F.lit(f"({cls}[^{cls[1:]}*)"), F.lit(1))


def n_strokes(p: Column) -> Column:
    """How many strokes come after the serve: the letters that a translation away takes from the rest."""
    rest = F.substring(p, 2, 1 << 30)
    return F.length(rest) - F.length(F.translate(rest, SHOTS, ""))


def stroke(p: Column, m: Column, i: Column, last: Column) -> list[Column]:
    """Columns of stroke i (0 is the serve) with run m of a played string whose last one is `last`."""
    serve, c, blank = i == 0, F.left(m, F.lit(1)), F.lit("")
    found = lambda pat: F.when(serve, blank).otherwise(F.coalesce(F.nullif(F.regexp_extract(m, pat, 0), blank), F.lit("?")))
    mark = F.right(p, F.lit(1))
    err = F.when(F.length(p) > 1, F.substring(p, -2, 1)).otherwise(blank)
    return [serve.alias("is_serve"), F.when(serve, F.substring(serve_token(p), 2, 1)).otherwise(blank).alias("serve_zone"), c.alias("letter"),
            F.when(serve, "serve").when(c.isin(*FOREHAND), "fh").when(c.isin(*BACKHAND), "bh").otherwise("?").alias("side"),
            found("[123]").alias("dir"), found(char_class(DEPTHS)).alias("depth"),
            F.when((i == last) & mark.isin(*ENDING_MARKS), mark).otherwise(blank).alias("ending"),
            F.when((i == last) & mark.isin("@", "#") & err.isin(*ERROR_LETTERS), err).otherwise(blank).alias("err")]


KNOWN = "".join(sorted(set(SERVE_DIGITS + SHOT_LETTERS + DIRECTIONS + DEPTHS + ERROR_LETTERS + ENDING_MARKS
                           + FAULT_LETTERS + OTHER_MARKS)))


def violations(s: Column, field: str, is_fault: Column) -> Column:
    """Array of {field, pos, msg}; pos is -1 for whole-string remarks."""
    item = lambda pos, msg: F.struct(F.lit(field).alias("field"), pos.cast("int").alias("pos"), msg.alias("msg"))
    none = F.slice(F.array(item(F.lit(0), F.lit(""))), 1, 0)
    one = lambda cond, pos, msg: F.when(cond, F.array(item(pos, F.lit(msg)))).otherwise(none)
    n = F.length(s)

    def mark(i):
        c = s.substr(i + 1, F.lit(1))
        orphan = (i > 0) & c.rlike(char_class(DIRECTIONS + DEPTHS)) & ~s.substr(F.lit(1), i).rlike(char_class(SHOT_LETTERS))
        msg = F.when(~c.rlike(char_class(KNOWN)), F.lit("unknown mark")).when(orphan, F.lit("digit follows no shot"))
        return item(i, msg)

    marks = F.filter(F.transform(F.sequence(F.lit(0), n - 1), mark), lambda m: m["msg"].isNotNull())
    end, before = last_char(s), F.when(n > 1, F.substring(s, -2, 1)).otherwise("")
    start = one(~F.substring(s, 1, 1).isin(*SERVE_DIGITS), F.lit(0), "no serve digit at start")
    fault = one(~F.substring(s, 2, 1 << 30).rlike(char_class(FAULT_LETTERS)), F.lit(-1), "first should be a fault")
    close = F.concat(one(~end.isin(*ENDING_MARKS), n - 1, "no ending mark"),
                     one(end.isin("@", "#") & ~before.isin(*ERROR_LETTERS), n - 1, "error ending without an error letter"))
    body = F.concat(start, marks, F.when(is_fault, fault).otherwise(close))
    return F.when(n == 0, F.array(item(F.lit(-1), F.lit("empty")))).otherwise(body)
