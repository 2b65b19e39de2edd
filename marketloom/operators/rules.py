"""Saved conditions as a small language of their own.

A rule's text is read into a tree of tuples and the tree is compiled to columns node by node. Only what the grammar names
can come out: columns of the frame, literals, operators and the functions listed here. The text itself never reaches Spark, so there is
nothing in it to quote, comment out or escape from.

Both ways of writing are understood: SQL conditions (``ad_title like '%Norco%' and price between 500 and 900``) and data-frame
queries (``ad_title.str.contains('norco|kona', case=False) & price < 900 & category in ['Trail Bikes']``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class RuleError(ValueError):
    """A rule that cannot be read, is not allowed or does not resolve against the columns."""


# Functions that a rule may call and how many arguments each takes.
FUNCTIONS = {
    **dict.fromkeys("abs ceil floor length lower upper month year day isnull isnotnull".split(), (1, 1)),
    **dict.fromkeys("trim ltrim rtrim to_date try_to_date".split(), (1, 1)),
    **dict.fromkeys("contains startswith endswith instr nullif nvl ifnull date_add date_sub date_diff datediff try_divide array_contains regexp_like".split(), (2, 2)),
    **dict.fromkeys("coalesce concat greatest least".split(), (1, 20)),
    "round": (1, 2), "substring": (2, 3), "substr": (2, 3), "replace": (2, 3), "if": (3, 3), "current_date": (0, 0),
}
TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "float": "float", "double": "double", "string": "string", "date": "date", "timestamp": "timestamp", "boolean": "boolean", "decimal": "decimal(38,10)"}
METHODS = ("contains", "startswith", "endswith", "lower", "upper", "strip", "len", "match")
KEYWORDS = set("and or not in between like ilike rlike is null case when then else end true false none".split())
DEEPEST = 100
LONGEST = 10_000

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<quoted>`[^`]+`)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><=|>=|==|!=|<>|\|\||[-+*/%<>=&|~(),.\[\]]))""",
    re.X | re.S,
)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; comments, semicolons and stray characters are errors."""
    if len(text) > LONGEST:
        raise RuleError("too long")
    out, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found or re.match(r"\s*(--|/\*|#)", text[at:]):
            raise RuleError(f"cannot read: {text[at : at + 20].strip()}")
        kind, word = found.lastgroup, found.group(found.lastgroup)
        if kind == "name" and word.lower() in KEYWORDS:
            kind, word = "word", word.lower()
        elif kind == "string":
            word = re.sub(r"\\(.)|(['\"])\2", _unescaped, word[1:-1], flags=re.S)
        elif kind == "quoted":
            kind, word = "name", word[1:-1]
        out.append((kind, word))
        at = found.end()
    return out


def _unescaped(found: re.Match) -> str:
    if found.group(2):
        return found.group(2)
    # Patterns of LIKE and regular expressions keep their backslashes; only quotes and backslashes are escaped.
    return found.group(1) if found.group(1) in "'\"\\" else found.group(0)


class _Reader:
    """Recursive descent over the tokens; every method returns a node."""

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    def peek(self, *words: str, kind: tuple[str, ...] = ("op", "word")) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in kind and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise RuleError(f"{word} is missing")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise RuleError(f"{kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise RuleError(f"cannot read: {self.tokens[self.at][1][:20]}")
        return node

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise RuleError("nested too deeply")
        node = self.both()
        while self.take("or", "|"):
            node = ("or", node, self.both())
        self.depth -= 1
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and", "&"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        turns = 0
        while self.take("not", "~"):
            turns += 1
        node = self.comparison()
        return ("not", node) if turns % 2 else node

    def comparison(self) -> tuple:
        node = self.sum()
        found = None
        left = node
        while op := self.take("=", "==", "!=", "<>", "<=", ">=", "<", ">"):  # a < b < c holds if both do
            right = self.sum()
            step = ("compare", {"==": "=", "<>": "!="}.get(op, op), left, right)
            found, left = step if found is None else ("and", found, step), right
        if found:
            return found
        if self.take("is"):
            turned = bool(self.take("not"))
            if not self.take("null", "none"):
                raise RuleError("null is missing")
            return ("not", ("null", node)) if turned else ("null", node)
        turned = bool(self.take("not"))
        if self.take("in"):
            close = "]" if self.take("[") else ")" if self.take("(") else None
            if not close:
                raise RuleError("a list is missing")
            told = ("in", node, self.items(close))
        elif self.take("between"):
            low = self.sum()
            self.need("and")
            told = ("and", ("compare", ">=", node, low), ("compare", "<=", node, self.sum()))
        elif kind := self.take("like", "ilike", "rlike"):
            told = (kind, node, self.next("string"))
        elif turned:
            raise RuleError("not is out of place")
        else:
            return node
        return ("not", told) if turned else told

    def items(self, close: str) -> list[tuple]:
        out = []
        while not self.take(close):
            if out:
                self.need(",")
            out.append(self.either())
        return out

    def sum(self) -> tuple:
        node = self.product()
        while op := self.take("+", "-", "||"):
            node = ("arith", op, node, self.product())
        return node

    def product(self) -> tuple:
        node = self.signed()
        while op := self.take("*", "/", "%"):
            node = ("arith", op, node, self.signed())
        return node

    def signed(self) -> tuple:
        turns = 0
        while op := self.take("-", "+"):
            turns += op == "-"
        node = self.primary()
        return ("minus", node) if turns % 2 else node

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise RuleError("the text ends early")
        kind, word = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return ("value", float(word) if re.search("[.eE]", word) else int(word))
        if kind == "string":
            self.at += 1
            return ("value", word)
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if word_ := self.take("true", "false", "null", "none"):
            return ("value", {"true": True, "false": False}.get(word_))
        if self.take("case"):
            return self.case()
        name = self.next("name")
        if self.take("("):
            return self.call(name.lower())
        node = ("column", name)
        while self.take("."):
            node = self.method(node)
        return node

    def case(self) -> tuple:
        on = None if self.peek("when") else self.sum()
        steps = []
        while self.take("when"):
            test = self.either()
            self.need("then")
            steps.append((("compare", "=", on, test) if on else test, self.either()))
        last = self.either() if self.take("else") else ("value", None)
        self.need("end")
        if not steps:
            raise RuleError("when is missing")
        return ("case", steps, last)

    def call(self, name: str) -> tuple:
        if name in ("cast", "try_cast"):
            node = self.either()
            if self.at >= len(self.tokens) or self.tokens[self.at][1].lower() != "as":
                raise RuleError("as is missing")
            self.at += 1
            kind = self.next("name").lower()
            self.need(")")
            if kind not in TYPES:
                raise RuleError(f"not a type: {kind}")
            return ("cast", node, TYPES[kind])
        if name not in FUNCTIONS:
            raise RuleError(f"not allowed in a rule: {name}")
        args = self.items(")")
        low, high = FUNCTIONS[name]
        if not low <= len(args) <= high:
            raise RuleError(f"{name} takes {low} to {high} arguments")
        return ("call", name, args)

    def method(self, node: tuple) -> tuple:
        """``.str.contains('x', case=False)`` and the like, ``.isnull()``, ``.notnull()``."""
        name = self.next("name").lower()
        if name in ("isnull", "isna", "notnull", "notna"):
            self.need("(")
            self.need(")")
            return ("null", node) if name in ("isnull", "isna") else ("not", ("null", node))
        if name != "str":
            raise RuleError(f"not allowed in a rule: .{name}")
        self.need(".")
        name = self.next("name").lower()
        if name not in METHODS:
            raise RuleError(f"not allowed in a rule: .str.{name}")
        self.need("(")
        text, options, first = None, {"case": True, "regex": True}, True
        while not self.take(")"):
            if not first:
                self.need(",")
            first = False
            if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("op", "="):
                option = self.tokens[self.at][1].lower()
                self.at += 2
                value = self.take("true", "false")
                if option not in ("case", "regex", "na") or value is None:
                    raise RuleError(f"not allowed in a rule: {option}")
                options[option] = value == "true"
            elif text is None:
                text = self.next("string")
            else:
                raise RuleError("one argument too many")
        if (text is None) != (name in ("lower", "upper", "strip", "len")):
            raise RuleError(f".str.{name} takes another number of arguments")
        return ("method", name, node, text, options)


def parse(text: str) -> tuple:
    """Tree of a rule; raises RuleError where the grammar does not allow the text."""
    return _Reader(text).whole()


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_ARITH: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "||": F.concat,
}


def compile_rule(node: tuple, columns: dict[str, str]) -> Column:
    """Column of a tree; ``columns`` maps lower-case names to the frame's columns."""
    kind, *parts = node
    made = lambda x: compile_rule(x, columns)
    if kind == "value":
        return F.lit(parts[0])
    if kind == "column":
        if parts[0].lower() not in columns:
            raise RuleError(f"no such column: {parts[0]}")
        return F.col("`" + columns[parts[0].lower()].replace("`", "``") + "`")
    if kind in ("and", "or"):
        a, b = map(made, parts)
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~made(parts[0])
    if kind == "null":
        return made(parts[0]).isNull()
    if kind == "minus":
        return -made(parts[0])
    if kind in ("compare", "arith"):
        return (_COMPARE if kind == "compare" else _ARITH)[parts[0]](made(parts[1]), made(parts[2]))
    if kind == "in":
        return made(parts[0]).isin(*map(made, parts[1])) if parts[1] else F.lit(False)
    if kind in ("like", "ilike", "rlike"):
        return getattr(made(parts[0]), kind)(parts[1])
    if kind == "cast":
        return made(parts[0]).try_cast(parts[1])
    if kind == "call":
        return F.call_function(parts[0], *map(made, parts[1]))
    if kind == "case":
        steps, last = parts
        told = F.when(made(steps[0][0]), made(steps[0][1]))
        for test, value in steps[1:]:
            told = told.when(made(test), made(value))
        return told.otherwise(made(last))
    return _string_method(parts[0], made(parts[1]), *parts[2:])


def _string_method(name: str, value: Column, text: str | None, options: dict) -> Column:
    if name in ("lower", "upper", "strip", "len"):
        return {"lower": F.lower, "upper": F.upper, "strip": F.trim, "len": F.length}[name](value)
    if name in ("startswith", "endswith"):
        found = getattr(value, name)(F.lit(text))
    elif name == "contains" and not options["regex"]:
        found = value.contains(F.lit(text)) if options["case"] else F.lower(value).contains(F.lower(F.lit(text)))
    else:
        start = r"\A(?:" + text + ")" if name == "match" else text
        found = value.rlike(start if options["case"] else "(?iu)" + start)
    return F.coalesce(found, F.lit(options["na"])) if "na" in options else found


def rule_column(df: DataFrame, text: str) -> Column:
    """Condition of a rule over a frame; raises RuleError when it is not allowed, misspells a column or is no condition."""
    try:
        predicate = compile_rule(parse(text or ""), {c.lower(): c for c in df.columns})
        if df.select(predicate.alias("hit")).schema["hit"].dataType.typeName() != "boolean":
            raise RuleError(f"not a condition: {text}")
        return predicate
    except (AnalysisException, RecursionError, OverflowError) as error:
        raise RuleError(str(error).split("\n")[0]) from error
