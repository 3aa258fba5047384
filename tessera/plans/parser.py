"""Text of a statement to what it asks for.

The grammar is small: conjunctive predicates over unqualified columns, comma
joins, grouping, ordering (also by distance from a vector), limits, and the
usual statements for data and definitions.  A statement ends where its text
ends; anything left over is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.errors import BadSyntax
from tessera.functions.vectors import SHORT
from tessera.operators.relational import AGGREGATES
from tessera.operators.predicates import Constant, Name, Operand, Predicate, Term

WORDS = frozenset(
    "select from where and group by order asc desc limit explain insert into values delete update set create table view index on using as drop int long double varchar vector add sub mul div avg count max min sum distinct euc cos hash btree ivf".split()
)
_LEX = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<text>'(?:[^']|'')*')|(?P<word>[A-Za-z_][A-Za-z_0-9.]*)|(?P<mark><=|>=|[=<>(),\[\]])|(?P<bad>\S))")

@dataclass(frozen=True)
class Aggregate:
    fn: str
    column: str


@dataclass(frozen=True)
class Near:
    """ORDER BY column <EUC> vector."""

    column: str
    distance: str
    query: tuple[float, ...]


@dataclass(frozen=True)
class Sort:
    by: str | Aggregate | Near
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    columns: tuple[str | Aggregate, ...]
    tables: tuple[str, ...]
    where: Predicate = Predicate()
    group: tuple[str, ...] | None = None
    order: tuple[Sort, ...] = ()
    limit: int | None = None
    explain: bool = False

    @property
    def aggregates(self) -> tuple[Aggregate, ...]:
        return tuple(c for c in self.columns if isinstance(c, Aggregate))


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Constant, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Operand | Arithmetic], ...]
    where: Predicate


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str, int | None], ...]


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Select
    text: str


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    columns: tuple[str, ...]
    kind: str = "btree"


@dataclass(frozen=True)
class Drop:
    what: str
    name: str


Statement = Select | Insert | Delete | Update | CreateTable | CreateView | CreateIndex | Drop


@dataclass
class Reader:
    """Tokens of a statement, read from the front."""

    source: str
    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        for m in _LEX.finditer(self.source.rstrip().removesuffix(";")):
            kind = m.lastgroup
            if kind == "bad":
                raise BadSyntax(f"unexpected {m['bad']!r} at {m.start('bad')}")
            self.tokens.append((kind, m[kind].lower() if kind == "word" else m[kind], m.start(kind)))
        self.tokens.append(("end", "", len(self.source)))

    def next_is(self, *values: str) -> bool:
        kind, value, _ = self.tokens[self.at]
        return kind in ("word", "mark") and value in values

    def skip(self, *values: str) -> bool:
        """Takes these words or marks if all of them come next."""
        if all(t[0] in ("word", "mark") and t[1] == v for t, v in zip(self.tokens[self.at :], values)) and len(self.tokens) - self.at > len(values):
            self.at += len(values)
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.skip(*values):
            raise self.wrong(" ".join(values))

    def wrong(self, wanted: str) -> BadSyntax:
        kind, value, at = self.tokens[self.at]
        return BadSyntax(f"{wanted} wanted at {at}, not {value or kind}")

    def take(self, kind: str) -> str:
        k, value, _ = self.tokens[self.at]
        if k != kind:
            raise self.wrong(f"a {kind}")
        self.at += 1
        return value

    def name(self) -> str:
        k, value, _ = self.tokens[self.at]
        if k != "word" or value in WORDS:
            raise self.wrong("a name")
        self.at += 1
        return value

    def listed(self, item):
        out = [item()]
        while self.skip(","):
            out.append(item())
        return tuple(out)

    def bracketed(self, item):
        self.need("(")
        out = self.listed(item)
        self.need(")")
        return out

    def number(self) -> int | float:
        text = self.take("number")
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)

    def size(self) -> int:
        n = self.number()
        if not isinstance(n, int) or n < 0:
            raise BadSyntax(f"a whole number wanted, not {n}")
        return n

    def vector(self) -> tuple[float, ...]:
        self.need("[")
        out = self.listed(lambda: float(self.number()))
        self.need("]")
        return out

    def constant(self) -> Constant:
        kind, _, _ = self.tokens[self.at]
        if kind == "number":
            return Constant(self.number())
        if kind == "text":
            return Constant(self.take("text")[1:-1].replace("''", "'"))
        return Constant(self.vector())

    def operand(self) -> Operand:
        return Name(self.name()) if self.tokens[self.at][0] == "word" else self.constant()

    def term(self) -> Term:
        left = self.operand()
        if not self.next_is("=", "<", "<=", ">", ">="):
            raise self.wrong("a comparison")
        op = self.take("mark")
        return Term(left, op, self.operand())

    def where(self) -> Predicate:
        if not self.skip("where"):
            return Predicate()
        terms = [self.term()]
        while self.skip("and"):
            terms.append(self.term())
        return Predicate(tuple(terms))

    def output(self) -> str | Aggregate:
        for fn in AGGREGATES:
            if self.skip(fn, "("):
                distinct = self.skip("distinct")
                if distinct and fn != "count":
                    raise BadSyntax(f"distinct is for count only, not {fn}")
                made = Aggregate("count_distinct" if distinct else fn, self.name())
                self.need(")")
                return made
        return self.name()

    def sort(self) -> Sort:
        by = self.output()
        if isinstance(by, str) and self.skip("<"):
            for short, distance in SHORT.items():
                if self.skip(short, ">"):
                    return Sort(Near(by, distance, self.vector()))
            raise self.wrong(" or ".join(SHORT))
        return Sort(by, not self.skip("desc") and (self.skip("asc") or True))

    def select(self) -> Select:
        explain = self.skip("explain")
        self.need("select")
        columns = self.listed(self.output)
        self.need("from")
        tables = self.listed(self.name)
        where = self.where()
        group = self.listed(self.name) if self.skip("group", "by") else None
        order = self.listed(self.sort) if self.skip("order", "by") else ()
        limit = self.size() if self.skip("limit") else None
        return Select(columns, tuple(dict.fromkeys(tables)), where, group, order, limit, explain)

    def change(self) -> tuple[str, Operand | Arithmetic]:
        target = self.name()
        self.need("=")
        for op in ("add", "sub", "mul", "div"):
            if self.skip(op, "("):
                left = self.operand()
                self.need(",")
                made = Arithmetic(op, left, self.operand())
                self.need(")")
                return target, made
        return target, self.operand()

    def declared(self) -> tuple[str, str, int | None]:
        column = self.name()
        for kind in ("int", "long", "double"):
            if self.skip(kind):
                return column, kind, None
        for kind in ("varchar", "vector"):
            if self.skip(kind, "("):
                size = self.size()
                self.need(")")
                return column, kind, size
        raise self.wrong("a type")

    def create(self) -> Statement:
        if self.skip("table"):
            return CreateTable(self.name(), self.bracketed(self.declared))
        if self.skip("view"):
            view = self.name()
            self.need("as")
            begin = self.tokens[self.at][2]
            return CreateView(view, self.select(), self.source[begin:].strip())
        self.need("index")
        index = self.name()
        self.need("on")
        table, columns, kind = self.name(), self.bracketed(self.name), "btree"
        if self.skip("using"):
            kind = next((k for k in ("hash", "btree", "ivf") if self.skip(k)), "")
            if not kind:
                raise self.wrong("hash, btree or ivf")
        return CreateIndex(index, table, columns, kind)

    def statement(self) -> Statement:
        if self.skip("insert", "into"):
            table, columns = self.name(), self.bracketed(self.name)
            self.need("values")
            return Insert(table, columns, self.bracketed(self.constant))
        if self.skip("delete", "from"):
            return Delete(self.name(), self.where())
        if self.skip("update"):
            table = self.name()
            self.need("set")
            return Update(table, self.listed(self.change), self.where())
        if self.skip("create"):
            return self.create()
        if self.skip("drop"):
            what = next((w for w in ("table", "view", "index") if self.skip(w)), "")
            if not what:
                raise self.wrong("table, view or index")
            return Drop(what, self.name())
        return self.select()


def parse(text: str) -> Statement:
    """One statement, all of the text."""
    reader = Reader(text)
    out = reader.statement()
    if reader.tokens[reader.at][0] != "end":
        raise reader.wrong("the end")
    return out
