"""Facts from source and the meaning of type names."""

from __future__ import annotations

from codeloom.operators import extract, names
from codeloom.session import staged

ORDINARY = '''package a.b;
import java.util.*;
import static x.Y.z;
/** Doc of C. */
public abstract class C<T> extends Base<T> implements Some, p.Other<T> {
  static { init(); }
  Runnable r = () -> h();
  Object[] os = { f(1), new D(2) };
  /** m doc { } */
  @Override @Named("x") public Map<String, List<T>> run(final int x, java.util.List<? extends T>[] y, String... z) throws IOException, p.E {
    if (x > 3 && y != null) throw new p.Bad("}{"); else if (x == 2) { foo(new Runnable() { public void run() { call(); } }, 1); } else throw new Other();
    try (X q = open()) { a.b(); for (int i = 0; i < 3; i++) { c(i); } } catch (java.io.IOException | Foo e) { throw e; } finally { close(); }
    String s = """ class Fake { void f() { g(); } } """; // class Not { }
    list.forEach(v -> { each(v); });
    return null;
  }
}
enum Q { A { void k() { z(); } }, B(1) { int y() { return w(); } }, D(2); Q(int i) { v(); } Q() { this(1); } abstract int up(int[] a, Map<String,List<B>> m[]) throws X; }
interface I<T> extends J, K<T> { void f(); }
class My extends Exception { void g() { try { a(); try { b(); } catch (E1 e) { throw e; } finally { } } catch (E2 | E3 x) { if (p) { throw x; } else { q(); } while (t) throw make(); } } }
'''
RUN = "a.b.C.run(int,List<? extends T>[],String[])"
CLAUSE = "java.io.IOException|Foo"


def facts_of(spark, *texts):
    files = spark.createDataFrame([(f"f{k}.java", t) for k, t in enumerate(texts)], "path string, content string")
    return staged(extract.extract(files), "facts")


def test_facts_of_an_ordinary_class(spark):
    rows = facts_of(spark, ORDINARY).collect()
    of = lambda kind, *cols: sorted(tuple("|".join(r[c]) if c == "catches" else r[c] for c in cols) for r in rows if r["kind"] == kind)
    assert of("type", "owner", "name", "detail") == [("a.b", "a.b.C", "abstract class"), ("a.b", "a.b.I", "interface"), ("a.b", "a.b.My", "class"), ("a.b", "a.b.Q", "class")]
    assert of("method", "owner", "name") == sorted([("a.b.C", RUN[6:]), ("a.b.C.Runnable{}", "run()"), ("a.b.I", "f()"), ("a.b.My", "g()"), ("a.b.Q", "Q()"), ("a.b.Q", "Q(int)"), ("a.b.Q", "up(int[],Map<String,List<B>>[])"), ("a.b.Q.A{}", "k()"), ("a.b.Q.B{}", "y()")])
    assert of("declares", "owner", "name") == sorted([(RUN, "IOException"), (RUN, "p.E"), ("a.b.Q.up(int[],Map<String,List<B>>[])", "X")])
    assert of("extends", "owner", "name", "detail") == [("a.b.C", "Base", "Inheritance"), ("a.b.I", "J", "Realization"), ("a.b.I", "K", "Realization"), ("a.b.My", "Exception", "Inheritance")]
    assert of("implements", "owner", "name") == [("a.b.C", "Some"), ("a.b.C", "p.Other")]
    calls = [(RUN, "b", CLAUSE, ""), (RUN, "c", CLAUSE, ""), (RUN, "close", "", ""), (RUN, "each", "", ""), (RUN, "foo", "", ""), (RUN, "forEach", "", ""), (RUN, "open", "", ""), ("a.b.C.Runnable{}.run()", "call", "", "")]
    calls += [("a.b.My.g()", "a", "E2|E3", ""), ("a.b.My.g()", "b", "E1|E2|E3", ""), ("a.b.My.g()", "make", "", "E2|E3"), ("a.b.My.g()", "q", "", "E2|E3"), ("a.b.Q.A{}.k()", "z", "", ""), ("a.b.Q.B{}.y()", "w", "", ""), ("a.b.Q.Q(int)", "v", "", "")]
    assert of("call", "owner", "name", "catches", "handler") == sorted(calls)
    throws = [(RUN, "p.Bad", "x > 3 && y != null", "", ""), (RUN, "Other", "x == 2", "", ""), (RUN, "", "", "", CLAUSE), ("a.b.My.g()", "E1", "", "E2|E3", "E1"), ("a.b.My.g()", "", "p", "", "E2|E3"), ("a.b.My.g()", "", "", "", "E2|E3")]
    assert of("throw", "owner", "name", "detail", "catches", "handler") == sorted(throws)
    assert of("catch", "owner", "name", "catches") == sorted([(RUN, CLAUSE, ""), ("a.b.My.g()", "E1", "E2|E3"), ("a.b.My.g()", "E2|E3", "")])
    assert of("comment", "owner", "name") == [("a.b.C", "/** Doc of C. */"), (RUN, "/** m doc { } */")]
    assert of("import", "name", "detail") == [("java.util.*", ""), ("x.Y.z", "static")]
    lines = {(r["kind"], r["name"]): r["line"] for r in rows}
    assert lines["call", "open"] == 11 and lines["type", "a.b.Q"] == 17


def test_broken_null_empty_and_long_texts(spark):
    long_ = "class L {\n" + "".join(f"  void m{k}() {{ c{k}(); }}\n" for k in range(1500)) + "  String s = \"" + "x" * 200_000 + "\";\n}\n"
    rows = facts_of(spark, None, "", "class { ( ", 'class A { void f() { g("', "class B { void f() { if (x) { y(); }", long_, "}}} class D { void f() { g(); } }").collect()
    names_ = {(r["path"], r["kind"], r["name"]) for r in rows}
    assert ("f4.java", "call", "y") in names_ and ("f6.java", "call", "g") in names_ and ("f3.java", "type", "A") in names_
    assert sum(r["path"] == "f5.java" and r["kind"] == "call" for r in rows) == 1500
    assert not {r["path"] for r in rows} & {"f0.java", "f1.java", "f2.java"}


def test_names_go_by_scope(spark):
    source = "package a;\nimport x.Foo;\nimport y.*;\nclass C { static class Foo { } static class In { } void f() throws Foo, In, Near, Far, Exception, x.Other, Map.Entry, Nothing { } }\nclass D { void f() throws Foo, In, C.In { } }\n"
    found = facts_of(spark, source)
    library = spark.createDataFrame([("a.Near",), ("y.Far",), ("y.Near",), ("a.y",), ("y.Map",)], "qualified_name string")
    got = {(r["scope"], r["name"]): (r["qualified"], r["how"]) for r in names.qualified(found, library).collect()}
    c, d = "a.C.f()", "a.D.f()"
    assert got[c, "Foo"] == ("a.C.Foo", "enclosing") and got[d, "Foo"] == ("x.Foo", "import")
    assert got[c, "In"] == ("a.C.In", "enclosing") and got[d, "In"] == (None, "unresolved") and got[d, "C.In"] == ("a.C.In", "package")
    assert got[c, "Near"] == ("a.Near", "package") and got[c, "Far"] == ("y.Far", "wildcard") and got[c, "Exception"] == ("java.lang.Exception", "java.lang")
    assert got[c, "x.Other"] == ("x.Other", "written") and got[c, "Map.Entry"] == ("y.Map.Entry", "wildcard") and got[c, "Nothing"] == (None, "unresolved")


def test_knowledge_tables_have_exceptions(spark):
    found = facts_of(spark, ORDINARY, "package q; class R extends IllegalStateException { } class S extends R { void f() { throw new S(); } }")
    tables = extract.knowledge(found, names.qualified(found))
    assert sorted(tuple(r) for r in tables["exceptions"].select("qualified_name", "parent", "exception_type").collect()) == [("a.b.My", "java.lang.Exception", "checked"), ("q.R", "java.lang.IllegalStateException", "runtime"), ("q.S", "q.R", "runtime")]
    assert ("q.S.f()", "q.S") in {(r["method"], r["exception"]) for r in tables["throws"].collect()}


def test_files_are_read_where_they_lie(spark):
    files = spark.createDataFrame([("a.java", ORDINARY)], "path string, content string")
    plan = extract.extract(files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Window" not in plan
    assert plan.count("Scan") == 1


def test_names_are_not_broadcast_by_their_files(spark):
    found = facts_of(spark, ORDINARY)
    known = staged(names.qualified(found), "known")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(extract.knowledge(found, known)["throws"]) and "Broadcast" not in plan(extract.knowledge(found, known)["throws"])
    assert "SortMergeJoin [path" in plan(names.with_qualified_catches(found.where("kind = 'call'"), known))
