"""The filter language: text -> tree -> Spark Column.

    owner = 'alice' AND (priority IN (HIGH, LOW) OR NOT m.count > 10)

Comparisons are `= != <> > < >= <=`, `[NOT] IN (...)`, `IS [NOT] NULL`. Values
are 'text', bare words (text too, never columns), integers, decimals `d.d`,
true/false and date('ISO'). NOT binds to the next operand only, AND before OR.
Characters that belong to no token are skipped; with strict=True they raise.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = bool | int | float | str | datetime


class FilterError(ValueError):
    """A filter text that cannot be read."""


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: Value


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[int, ...] | tuple[str, ...]


@dataclass(frozen=True)
class IsNull:
    field: str


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    expr: Expr


Expr = Comparison | In | IsNull | And | Or | Not

_TOKEN = re.compile(r"(?P<text>'[^']*')|(?P<word>[A-Za-z0-9_.]+)|(?P<op>!=|<>|>=|<=|=|>|<)|(?P<mark>[(),])|(?P<space>\s+)|(?P<other>.)", re.DOTALL)
_KEYWORDS = {"AND", "OR", "NOT", "IN", "IS"}


def _tokens(text: str, strict: bool) -> deque[tuple[str, str]]:
    out: deque[tuple[str, str]] = deque()
    for m in _TOKEN.finditer(text):
        kind, found = m.lastgroup, m.group()
        if kind == "other" and strict:
            raise FilterError(f"unknown character {found!r} at {m.start()}")
        if kind in ("space", "other"):
            continue
        if kind == "word" and found.upper() in _KEYWORDS:
            out.append((found.upper(), found))
        elif kind == "text":
            out.append(("text", found[1:-1]))
        else:
            out.append((found if kind == "mark" else kind, found))
    return out


class _Reader:
    def __init__(self, tokens: deque[tuple[str, str]]):
        self.tokens = tokens

    def peek(self) -> str:
        return self.tokens[0][0] if self.tokens else "end"

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            raise FilterError(f"expected {' or '.join(kinds)}, found {self.tokens[0][1] if self.tokens else 'the end'!r}")
        return self.tokens.popleft()[1]

    def chain(self, word: str, make, part: Callable[[], Expr]) -> Expr:
        found = part()
        while self.peek() == word:
            self.tokens.popleft()
            found = make(found, part())
        return found

    def any_of(self) -> Expr:
        return self.chain("OR", Or, self.all_of)

    def all_of(self) -> Expr:
        return self.chain("AND", And, self.operand)

    def operand(self) -> Expr:
        if self.peek() == "NOT":
            self.tokens.popleft()
            return Not(self.operand())
        if self.peek() == "(":
            self.take("(")
            found = self.any_of()
            self.take(")")
            return found
        field = self.take("word")
        match self.peek():
            case "op":
                op = self.take("op")
                return Comparison(field, "!=" if op == "<>" else op, self.value())
            case "IS":
                self.take("IS")
                negated = self.peek() == "NOT" and bool(self.take("NOT"))
                if self.take("word").upper() != "NULL":
                    raise FilterError("IS needs NULL or NOT NULL")
                return Not(IsNull(field)) if negated else IsNull(field)
            case "NOT":
                self.take("NOT")
                return Not(self.members(field))
            case "IN":
                return self.members(field)
        raise FilterError(f"{field!r} needs a comparison")

    def members(self, field: str) -> In:
        self.take("IN")
        self.take("(")
        values = [self.value()]
        while self.peek() == ",":
            self.take(",")
            values.append(self.value())
        self.take(")")
        kinds = {type(v) for v in values}
        if kinds not in ({int}, {str}):
            raise FilterError("an IN list holds integers only or texts only")
        return In(field, tuple(values))

    def value(self) -> Value:
        if self.peek() == "text":
            return self.take("text")
        word = self.take("word", "text")
        if word.lower() == "date" and self.peek() == "(":
            self.take("(")
            iso = self.take("text")
            self.take(")")
            try:
                return datetime.fromisoformat(iso)
            except ValueError as e:
                raise FilterError(f"no ISO date: {iso!r}") from e
        if word.upper() in ("TRUE", "FALSE"):
            return word.upper() == "TRUE"
        if re.fullmatch(r"\d+", word):
            return int(word)
        return float(word) if re.fullmatch(r"\d+\.\d+", word) else word


def parse_filter(text: str | None, strict: bool = False) -> Expr | None:
    """The tree of a filter text; None for no text."""
    tokens = _tokens(text or "", strict)
    if not tokens:
        return None
    reader = _Reader(tokens)
    found = reader.any_of()
    reader_left = reader.peek()
    if reader_left != "end":
        raise FilterError(f"unexpected {reader.tokens[0][1]!r}")
    return found


# fields


def normalise_field(field: str) -> tuple[str, bool]:
    """(name, whether it is the user's): m.x and metadata.x name x of the user's metadata."""
    for prefix in ("m.", "metadata."):
        if field.startswith(prefix):
            return field[len(prefix) :], True
    return field, False


def valid_identifier(name: str) -> bool:
    return re.fullmatch(r"[a-z0-9_]+", name) is not None and len(name.encode()) <= 32


def fields(expr: Expr | None) -> list[str]:
    match expr:
        case None:
            return []
        case And(a, b) | Or(a, b):
            return fields(a) + fields(b)
        case Not(a):
            return fields(a)
    return [expr.field]


def check_fields(expr: Expr | None, allowed: set[str] | None = None) -> None:
    """Raises for names that are no identifiers, or (closed schema) user fields not allowed."""
    for field in fields(expr):
        name, users = normalise_field(field)
        if not valid_identifier(name) or (users and allowed is not None and name not in allowed):
            raise FilterError(f"unknown field {field!r}")


def map_fields(expr: Expr | None, rename: Callable[[str], str]) -> Expr | None:
    """The same tree with every field renamed."""
    match expr:
        case None:
            return None
        case And(a, b):
            return And(map_fields(a, rename), map_fields(b, rename))
        case Or(a, b):
            return Or(map_fields(a, rename), map_fields(b, rename))
        case Not(a):
            return Not(map_fields(a, rename))
        case Comparison(f, op, v):
            return Comparison(rename(f), op, v)
        case In(f, v):
            return In(rename(f), v)
    return IsNull(rename(expr.field))


def merge(*exprs: Expr | None) -> Expr | None:
    """AND of those that are there."""
    found = None
    for e in exprs:
        found = e if found is None else found if e is None else And(found, e)
    return found


def within_sets(expr: Expr | None, set_ids: list[str]) -> Expr:
    """The filter, limited to the given set ids."""
    return merge(In("set_id", tuple(set_ids)), expr)


def equalities(expr: Expr | None) -> dict[str, Value] | None:
    """{field: value} of a conjunction of equalities; anything else raises."""
    match expr:
        case None:
            return None
        case Comparison(f, "=", v):
            return {f: v}
        case And(a, b):
            return (equalities(a) or {}) | (equalities(b) or {})
    raise TypeError("only equalities joined by AND make a property filter")


def definite_values(expr: Expr | None, field: str) -> set | None:
    """Values that the field must be one of, if the filter says so: AND intersects; OR, NOT and IS NULL tell nothing."""
    match expr:
        case Comparison(f, "=", v) if f == field:
            return {v}
        case In(f, v) if f == field:
            return set(v)
        case And(a, b):
            x, y = definite_values(a, field), definite_values(b, field)
            return y if x is None else x if y is None else x & y
    return None


def from_dict(values: dict[str, str]) -> str:
    """Filter text of text equalities; a quote is doubled."""
    for k, v in values.items():
        if not isinstance(v, str):
            raise TypeError(f"{k}: only texts can be given")
    return " AND ".join(f"{k}='{v.replace(chr(39), chr(39) * 2)}'" for k, v in values.items())


# compilation

#: A target makes the predicate of one comparison; it is told the operator, the value(s) and gets nulls right.
Resolver = Callable[[str], "Target"]
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def literal(value: Value) -> Column:
    """Naive datetimes are UTC."""
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=UTC)
        return F.timestamp_micros(F.lit(round(aware.astimezone(UTC).timestamp() * 1_000_000)))
    return F.lit(value)


@dataclass(frozen=True)
class Plain:
    """A physical column."""

    column: Column

    def compare(self, op: str, value: Value) -> Column:
        return _OPS[op](self.column, literal(value))

    def within(self, values: tuple) -> Column:
        return self.column.isin(*values) if values else F.lit(False)

    def is_null(self) -> Column:
        return self.column.isNull()


@dataclass(frozen=True)
class JsonPath:
    """A key of a JSON text column; the literal's type picks the cast. Datetimes are refused."""

    column: Column
    key: str

    def typed(self, kind: type) -> Column:
        found = F.get_json_object(self.column, f"$.{self.key}")
        name = {bool: "boolean", int: "bigint", float: "double"}.get(kind)
        return found if name is None else found.try_cast(name)

    def compare(self, op: str, value: Value) -> Column:
        if isinstance(value, datetime):
            raise TypeError("raw JSON fields have no datetimes")
        return _OPS[op](self.typed(type(value)), F.lit(value))

    def within(self, values: tuple) -> Column:
        return self.typed(type(values[0])).isin(*values) if values else F.lit(False)

    def is_null(self) -> Column:
        return F.get_json_object(self.column, f"$.{self.key}").isNull()


#: The map of typed properties: t names the type, one of the other fields holds the value, tz the offset in seconds.
TYPED = "map<string,struct<t:string,b:boolean,i:bigint,f:double,s:string,ts:timestamp,tz:int>>"
_TAGS = ((bool, "bool", "b"), (int, "int", "i"), (float, "float", "f"), (str, "str", "s"), (datetime, "datetime", "ts"))


@dataclass(frozen=True)
class TypedProperty:
    """A key of a typed property map: the type must agree AND the value compare; a missing key is null."""

    column: Column
    key: str

    def _of(self, value: Value) -> tuple[Column, Column]:
        kind, tag, name = next(x for x in _TAGS if isinstance(value, x[0]))
        entry = self.column[self.key]
        return entry["t"] == tag, entry[name]

    def compare(self, op: str, value: Value) -> Column:
        same, found = self._of(value)
        return same & _OPS[op](found, literal(value))

    def within(self, values: tuple) -> Column:
        if not values:
            return F.lit(False)
        same, found = self._of(values[0])
        return same & found.isin(*values)

    def is_null(self) -> Column:
        return self.column[self.key]["t"].isNull()


Target = Plain | JsonPath | TypedProperty


def compile_filter(expr: Expr | None, resolve: Resolver, two_valued: bool = False) -> Column:
    """The predicate of a tree, by SQL's three-valued logic.

    two_valued: every leaf is true or false: what compares with a missing value
    is false, but != is true.
    """
    match expr:
        case None:
            return F.lit(True)
        case And(a, b):
            return compile_filter(a, resolve, two_valued) & compile_filter(b, resolve, two_valued)
        case Or(a, b):
            return compile_filter(a, resolve, two_valued) | compile_filter(b, resolve, two_valued)
        case Not(a):
            return ~compile_filter(a, resolve, two_valued)
        case IsNull(f):
            return resolve(f).is_null()
        case In(f, values):
            leaf, missing = resolve(f).within(values), False
        case Comparison(f, op, value):
            leaf, missing = resolve(f).compare(op, value), op == "!="
    return F.coalesce(leaf, F.lit(missing)) if two_valued else leaf


def resolver(plain: dict[str, Column | str], metadata: Column | str | None = None, typed: bool = False, schema: set[str] | None = None, ignore_case: bool = False) -> Resolver:
    """Resolves names to the given columns, and m.x to the metadata column (JSON text, or a typed map)."""
    known = {(k.lower() if ignore_case else k): F.col(v) if isinstance(v, str) else v for k, v in plain.items()}
    users = F.col(metadata) if isinstance(metadata, str) else metadata

    def resolve(field: str) -> Target:
        name, is_users = normalise_field(field)
        if is_users:
            if users is None or (schema is not None and name not in schema):
                raise FilterError(f"unknown field {field!r}")
            return (TypedProperty if typed else JsonPath)(users, name)
        found = known.get(name.lower() if ignore_case else name)
        if found is None:
            raise FilterError(f"unknown field {field!r}")
        return Plain(found)

    return resolve


# Names of feature fields in filters, and their columns.
FEATURE_FIELDS = {
    "set_id": "set_id", "set": "set_id", "semantic_category_id": "category", "category_name": "category", "category": "category", "tag_id": "tag", "tag": "tag",
    "feature": "feature", "feature_name": "feature", "value": "value", "created_at": "created_at", "updated_at": "updated_at",
}


def feature_resolver(columns: list[str], metadata: str = "metadata") -> Resolver:
    """Fields of features that the table has; m.x is its JSON metadata."""
    return resolver({name: column for name, column in FEATURE_FIELDS.items() if column in columns}, metadata if metadata in columns else None)


def segment_resolver(properties: str = "properties", timestamp: str = "ts") -> Resolver:
    """Fields of segments: timestamp is a column, m.x the typed property x, and any other name the typed system property _name."""

    def resolve(field: str) -> Target:
        if field == "timestamp":
            return Plain(F.col(timestamp))
        name, is_users = normalise_field(field)
        return TypedProperty(F.col(properties), name if is_users else f"_{field}")

    return resolve
