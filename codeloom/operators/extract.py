"""Facts from Java source, out of tokens: types, methods, calls, throws, handlers, comments.

A fact is a token or a statement, and what is around it: the types and the method it belongs to,
the handlers of the tries in whose bodies it stands, the condition of the innermost `if` (which
also stands for its else branch). Calls and throws outside methods (in initializers, and in
fields, lambdas there too) are no facts; the methods of an anonymous class are methods of
`Created{}`. Names are as they are written, but for packages and outer types; names.py qualifies
them. A file is read by itself in Arrow batches, so files are not shuffled, nor are their tokens;
all that follows is DataFrame functions.

Null and empty texts have no facts; broken ones have those that can be read; names are looked up by
path, so paths must differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import closure
from codeloom.operators.tokens import KEYWORDS, SPACE, Source, Statement, name_pattern
from codeloom.session import staged

# The throwables of java.lang that name others, and their parents.
THROWABLES = {
    "Throwable": "Throwable",
    "Exception": "Throwable",
    "Error": "Throwable",
    "RuntimeException": "Exception",
    "CloneNotSupportedException": "Exception",
    "InterruptedException": "Exception",
    "ReflectiveOperationException": "Exception",
    "ClassNotFoundException": "ReflectiveOperationException",
    "NoSuchFieldException": "ReflectiveOperationException",
    "NoSuchMethodException": "ReflectiveOperationException",
    "ArithmeticException": "RuntimeException",
    "ArrayStoreException": "RuntimeException",
    "ClassCastException": "RuntimeException",
    "IllegalArgumentException": "RuntimeException",
    "IllegalStateException": "RuntimeException",
    "IndexOutOfBoundsException": "RuntimeException",
    "NegativeArraySizeException": "RuntimeException",
    "NullPointerException": "RuntimeException",
    "SecurityException": "RuntimeException",
    "UnsupportedOperationException": "RuntimeException",
    "NumberFormatException": "IllegalArgumentException",
    "AssertionError": "Error",
    "LinkageError": "Error",
    "StackOverflowError": "Error",
    "OutOfMemoryError": "Error",
}


_ARGUMENTS = re.compile(r"<[^<>]*>")
_REMARK = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*")
_ANNOTATION = r"@[A-Za-z0-9_$.]+(?:\([^)]*\))?"


def _without(pattern: re.Pattern, text: str, times: int) -> str:
    for _ in range(times):
        text = pattern.sub("", text)
    return text


def closed(name: str) -> str:
    """A name of several tokens, without the blanks between them and without type arguments."""
    return re.sub(r"@[^.]*", "", _without(_ARGUMENTS, name, 4).replace(" ", ""))


def listed(names: str) -> list[str]:
    """Names between commas, type arguments left out."""
    return [x for x in (x.replace(" ", "") for x in _without(_ARGUMENTS, names, 4).split(",")) if x]


class _Patterns:
    """Patterns of statements' heads, with blanks between their tokens."""

    def __init__(self) -> None:
        name = name_pattern()
        end = r"(?:\n?\Z)"
        self.type = re.compile(rf"(?:^|[{SPACE}])(class|interface|enum|record) ({name})(?: |{end})")
        self.creates = re.compile(r"(?:^|[ \t\n\x0B\f\r])new ([^(){};=]*) \( \) \{$")
        self.method = re.compile(rf"^([^=]*?)({name}) \( \)(?: \[ \])*(?: throws ([^{{;]*?))? [{{;]$")
        self.plain = re.compile(rf"^(?:, )?(?!(?:static|else|do|try|finally) )({name}) \{{$")
        self.modifiers = re.compile(r"^(?:(?:public|protected|private|static|abstract|final|native|synchronized|transient|strictfp|default|@ [^ ]+(?: \. [^ ]+)*(?: \( \))?) )*")
        self.typed = re.compile(r"(?:\w|[$>\]]) $")
        self.tries = re.compile(r"(?:^|[ \t\n\x0B\f\r])try (?:\( \) )?\{$")
        self.package = re.compile(r"^(?:@ .* )?package ([^;]*) ;$")
        self.last_name = re.compile(rf"({name})[{SPACE}]*$")
        self.last_word = re.compile(rf"[{SPACE}]+{name}[{SPACE}]*$")
        self.declared = re.compile(rf"{_REMARK.pattern}|\bfinal\b|{_ANNOTATION}")
        self.word = re.compile(name)
        self.variable = re.compile(rf"^({name}) ;$")
        self.new = re.compile(rf"^new ((?:{name} \. )*{name})")
        self.parents = {"extends": re.compile(r" extends (.*?)(?: implements .*| permits .*)? \{$"), "implements": re.compile(r" implements (.*?)(?: permits .*)? \{$")}
        self.sort = re.compile(r"^(.*?)(?:class|interface|enum|record) ")
        self.leaves = re.compile(rf"{_ANNOTATION}|\bfinal\b")
        self.parts = re.compile(rf"[\w$]+|\.\.\.|[^{SPACE}]")
        self.unnamed = re.compile(rf"[{SPACE}]*{name}((?: \[ \])*)$")
        self.outer = re.compile(rf"(?:{name} \. )+")


_patterns = cache(_Patterns)


@lru_cache(1 << 12)
def parameter_types(text: str) -> str:
    """The types of a parameter list as it is written, between commas: simple names with their type arguments, `...` as an array."""
    p = _patterns()
    deep, joined = 0, []
    for x in p.parts.findall(p.leaves.sub(" ", _REMARK.sub(" ", text))):
        joined.append("\n" if x == "," and deep == 0 else x + " ")
        deep += (x == "<") - (x == ">")

    def kind(of: str) -> str:
        simple = p.outer.sub("", p.unnamed.sub(r"\1", of.strip(" ")).replace("...", "[ ]"))
        return re.sub(r" ?\b(extends|super)\b ?", r"\t\1\t", simple).replace(" ", "").replace("\t", " ").replace("&", " & ")

    return ",".join(kind(x) for x in "".join(joined).split("\n") if x.strip(" "))


def _group(pattern: re.Pattern, text: str, n: int) -> str:
    m = pattern.search(text)
    return (m[n] if m else "") or ""


def _paren(s: Statement, after: int) -> tuple[int, int] | None:
    """(start, end) of the first bracket pair of a statement at or behind a place."""
    start = None
    for x in s.items:
        if start is None:
            if x.text == "(" and x.i >= after:
                start = x.i
        elif x.text == ")":
            return start, x.i
    return None


def _mark(source: Source) -> str | None:
    """Statements get kind, name, condition, the types of a catch clause, and those of the handlers of a try; returned is the file's package."""
    p, packages, runs = _patterns(), [], {}
    for s in sorted((s for of in source.statements.values() for s in of), key=lambda s: s.start):
        head, brace = s.head, s.head[-1] == "{"
        method = None
        if brace and p.type.search(head) and ". class " not in head:
            s.kind, s.name = "type", _group(p.type, head, 2)
        elif brace and (p.creates.search(head) or p.plain.search(head)):
            s.kind, s.name = "anonymous", closed(_group(p.creates, head, 1) or _group(p.plain, head, 1)) + "{}"
        elif head.endswith("-> {"):
            s.kind = "lambda"
        elif brace and p.tries.search(head):
            s.kind = "try"
        elif head == "catch ( ) {":
            s.kind = "catch"
        elif (brace or head[-1] == ";") and " ( ) " in head and (method := p.method.search(head)):
            s.kind, s.name = "method", method[2]
        if (method := method or (p.method.search(head) if s.kind != "other" and " ( ) " in head else None)) is not None:
            s.typed = p.typed.search(p.modifiers.sub("", method[1], count=1)) is not None
        ifs = [x.i for x in s.items if x.text == "if"]
        at = _paren(s, ifs[-1]) if ifs else None
        if at is not None:
            s.condition = source.between(*at).strip(" ")
        if s.kind in ("method", "catch"):
            opening = [x.i for x in s.items if x.text == "(" and (s.body is None or x.i < s.body)]
            at = _paren(s, s.start) if s.kind == "catch" else _paren(s, opening[-1]) if opening else None
            if at is not None:
                s.inside = source.between(*at).strip(" ")
        if s.kind == "catch" and s.inside is not None:
            declared = p.last_word.sub("", p.declared.sub(" ", s.inside))
            s.types = [x for x in (re.sub(rf"[{SPACE}]", "", x) for x in declared.split("|")) if x]
            s.variable = _group(p.last_name, s.inside, 1)
        if "package" in head and (name := _group(p.package, head, 1).replace(" ", "")):
            packages.append(name)
        run = runs.setdefault((s.around, s.run), [None, []])
        s.condition = run[0] = run[0] if s.condition is None else s.condition
        run[1] += s.types or []
        if s.kind == "try":
            s.handlers = run[1]  # the list of the run, which its later clauses fill
    return max(packages, default=None)


def _settled(outer: list[Statement]) -> list[tuple[Statement, str, str | None]]:
    """The statements around a place with kind and name: `method` only for those in the body of a type; a nameless one there with a body is a constant's."""
    out: list[tuple[Statement, str, str | None]] = []
    for k, s in enumerate(outer):
        above = outer[k - 1] if k else None
        constant = s.kind == "method" and not s.typed and s.body is not None and above is not None and above.kind == "type" and above.body == s.around and s.name != above.name
        out.append((s, "anonymous", s.name + "{}") if constant else (s, s.kind, s.name))
    for k, (s, kind, name) in enumerate(out):
        if kind == "method" and not (k and _inside(s, name, out[k - 1])):
            out[k] = s, "other", name
    return out


def _inside(s: Statement, name: str | None, above: tuple[Statement, str, str | None]) -> bool:
    """Whether a statement that looks like a method is one of the type above it."""
    return above[1] in ("type", "anonymous") and above[0].body == s.around and (s.typed or name == above[2])


def _dotted(*names: str | None) -> str:
    return ".".join(x for x in names if x is not None)


def source_facts(text: str | None) -> Iterator[tuple]:
    """The facts of one file, see extract(): kind, owner, name, detail, catches, handler, line, seq."""
    if not text:
        return
    source, p = Source(text), _patterns()
    package = _mark(source)
    full = lambda s: f"{s.name}({parameter_types(s.inside or '')})"
    places: dict[tuple, tuple] = {}

    def of(outer: list[Statement]) -> tuple:
        """What a place has from the statements around it: settled, the class, the method's name, the handlers by tries, clause, condition."""
        key = tuple(s.start for s in outer)
        if key not in places:
            settled = _settled(outer)
            types = [(s, n) for s, k, n in settled if k in ("type", "anonymous")]
            class_ = _dotted(package, ".".join(n for _, n in types) or None)
            method = next((s for s, k, _ in reversed(settled) if k == "method"), None)
            owner, inner = None, []
            if method is not None:
                inner = [(s, k) for s, k, _ in settled if s.start > method.start]
                owner = _dotted(package, _dotted(".".join(n for s, n in types if s.start < method.start), full(method)) or None)
            clause = next((s for s, k in reversed(inner) if k == "catch"), None)
            condition = next((s.condition for s, _ in reversed(inner) if s.condition is not None), "")
            tries = [s for s, k in reversed(inner) if k == "try"]
            places[key] = settled, class_, owner, tries, clause, condition
        return places[key]

    def caught(tries: list[Statement], i: int) -> list[str]:
        return [x for s in tries if i > s.body for x in s.handlers]

    def handler(clause: Statement | None) -> str:
        return "|".join(clause.types or []) if clause is not None else ""

    for level, tokens in source.levels.items():
        for t in tokens:
            if t.next == "(" and t.text not in KEYWORDS and t.chain not in ("new", "@") and p.word.fullmatch(t.text):
                settled, _, owner, tries, clause, _ = of(source.around(t.i, level))
                above = settled[-1] if settled else None
                # a name at the level of its own declaration is no call
                if owner is not None and not (above[1] in ("method", "type") and above[0].around == t.around):
                    yield "call", owner, t.text, "", caught(tries, t.i), handler(clause), t.line, t.i
    for level, statements in source.statements.items():
        for s in statements:
            for k, t in enumerate(s.items):
                if t.text == "throw":
                    _, _, owner, tries, clause, condition = of(source.around(t.i, level))
                    if owner is not None:
                        head = " ".join(x.text for x in s.items[k + 1 :])
                        name = closed(_group(p.new, head, 1))
                        if not name and clause is not None and clause.types is not None and len(clause.types) == 1 and _group(p.variable, head, 1) == clause.variable:
                            name = clause.types[0]
                        yield "throw", owner, name, condition, caught(tries, t.i), handler(clause), t.line, t.i
            if s.head.startswith("import "):
                static = s.head.startswith("import static ")
                yield "import", package or "", re.sub(r"[ ;]", "", s.head[len("import static " if static else "import ") :]), "static" if static else "", [], "", s.line, s.start
            if s.kind not in ("type", "method", "catch"):
                continue
            settled, class_, owner, tries, clause, _ = of(source.around(s.start, level - 1))
            doc = s.doc is not None and s.doc.startswith("/**")
            rest = [], "", s.line, s.start
            if s.kind == "catch":
                if owner is not None:
                    yield "catch", owner, None if s.types is None else "|".join(s.types), "", caught(tries, s.start), handler(clause), s.line, s.start
            elif s.kind == "type":
                whole, sort = _dotted(class_ or None, s.name), _group(p.type, s.head, 1)
                abstract = re.search(r"(?:^| )abstract ", _group(p.sort, s.head, 1))
                yield "type", class_, whole, "interface" if "@ interface " in s.head or sort == "interface" else "abstract class" if abstract else "class", *rest
                bare = _without(_ARGUMENTS, s.head, 3)
                for clause_, pattern in p.parents.items():
                    for parent in listed(_group(pattern, bare, 1)):
                        yield clause_, whole, parent, "Realization" if clause_ == "implements" or sort == "interface" else "Inheritance", *rest
                if doc:
                    yield "comment", whole, s.doc, "type", *rest
            elif settled and _inside(s, s.name, settled[-1]):
                yield "method", class_, full(s), "", *rest
                for thrown in listed(_group(p.method, s.head, 3)):
                    yield "declares", _dotted(class_, full(s)), thrown, "", *rest
                if doc:
                    yield "comment", _dotted(class_, full(s)), s.doc, "method", *rest


#: Facts of at most so many rows make a batch, but for the last file's.
BATCH = 20_000
FACTS = "path string, kind string, owner string, name string, detail string, catches array<string>, handler string, line int, seq int"


def extract(files: DataFrame) -> DataFrame:
    """Facts of (path, content) files: path, kind, owner, name, detail, catches, handler, line, seq (place in the file).

    kind: type (detail: class type), extends / implements (detail: relation), method, declares (what a method declares
    to throw), call, throw (detail: innermost condition; name: what is thrown, empty if the text does not tell), catch,
    comment (of a type or method), import. catches: types of the handlers around, innermost first; handler: the catch
    clause a throw or call stands in.
    """
    files = files.select(F.col("path").cast("string"), F.col("content").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), *((c, pa.string()) for c in ("kind", "owner", "name", "detail")), ("catches", pa.list_(pa.string())), ("handler", pa.string()), ("line", pa.int32()), ("seq", pa.int32())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                where = path.as_py()
                rows += ((where, *fact) for fact in source_facts(text.as_py()))
                if len(rows) >= BATCH:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return files.mapInArrow(run, FACTS)


def call_sites(found: DataFrame) -> DataFrame:
    """Call sites with the handlers around them, as graph.edges_from_sites takes them."""
    calls = found.where("kind = 'call'")
    return calls.select(F.col("owner").alias("caller"), F.col("name").alias("callee"), F.concat_ws(":", "path", F.col("seq").cast("string")).alias("site_id"), F.col("catches").alias("catch_types"))


def exceptions(found: DataFrame, inherits: DataFrame) -> DataFrame:
    """(qualified_name, parent, exception_type) of the types that are throwable: `runtime` or `checked`. inherits: class, parent, relation."""
    spark = found.sparkSession
    base = spark.createDataFrame([(f"java.lang.{c}", f"java.lang.{p}") for c, p in THROWABLES.items()], "child string, parent string")
    own = inherits.where("relation = 'Inheritance'").select(F.col("class").alias("child"), "parent")
    above = closure.ancestors(own.unionByName(base))
    flags = above.groupBy(F.col("child").alias("qualified_name")).agg(F.max(F.col("ancestor") == "java.lang.Throwable").alias("t"), F.max(F.col("ancestor") == closure.RUNTIME).alias("r"))
    kept = flags.where("t").join(own.groupBy(F.col("child").alias("qualified_name")).agg(F.min("parent").alias("parent")), "qualified_name")
    return kept.select("qualified_name", "parent", F.when(F.col("r"), "runtime").otherwise("checked").alias("exception_type"))


def knowledge(found: DataFrame, qualified: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that facts fill: classes, exceptions, methods, belongs, calls, throws, inherits, files, locates.

    qualified: names.qualified(found), where names of types are to be known by their packages.
    """
    of = lambda kind: found.where(F.col("kind") == kind)

    def named(rows: DataFrame) -> DataFrame:
        """rows whose `name` is a type's, qualified where that is known."""
        if qualified is None:
            return rows
        known = qualified.where("qualified is not null").select(F.col("path").alias("_p"), F.col("scope").alias("_s"), F.col("name").alias("_n"), "qualified")
        return rows.join(known.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("owner") == F.col("_s")) & (F.col("name") == F.col("_n")), "left").withColumn("name", F.coalesce("qualified", "name")).drop("_p", "_s", "_n", "qualified")

    comments = of("comment").groupBy(F.col("owner").alias("_owner"), F.col("detail").alias("_of")).agg(F.max_by("name", "seq").alias("comment"))
    about = lambda rows, of_: rows.join(comments.where(F.col("_of") == of_), F.col("qualified_name") == F.col("_owner"), "left").drop("_owner", "_of")
    full = F.concat_ws(".", "owner", "name")
    inherits = staged(named(found.where("kind in ('extends', 'implements')")).select(F.col("owner").alias("class"), F.col("name").alias("parent"), F.col("detail").alias("relation")), "inherits")
    return {
        "classes": about(of("type").select(F.col("name").alias("qualified_name"), F.col("detail").alias("class_type"), "path", "seq"), "type"),
        "exceptions": exceptions(found, inherits),
        "methods": about(of("method").select(full.alias("qualified_name"), "path", "seq"), "method"),
        "belongs": of("method").select(full.alias("method"), F.col("owner").alias("class")),
        "calls": of("call").select(F.col("owner").alias("method"), F.col("name").alias("method_been_call")),
        "throws": named(of("throw")).select(F.col("owner").alias("method"), F.col("name").alias("exception"), F.lit("throw statement").alias("throw_way"), F.col("detail").alias("throw_condition"), "path", "seq").unionByName(
            named(of("declares")).select(F.col("owner").alias("method"), F.col("name").alias("exception"), F.lit("declaration").alias("throw_way"), F.lit("").alias("throw_condition"), "path", "seq")
        ),
        "inherits": inherits,
        "files": found.select(F.col("path").alias("file_path")).distinct(),
        "locates": of("type").select(F.col("path").alias("file_path"), F.col("name").alias("class")),
    }
