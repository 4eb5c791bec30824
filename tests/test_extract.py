"""Extractors on small sources with their expected entities and edges."""

from codeloom.extract import csharp, java, registry, script
from codeloom.extract.registry import extract_file


def read(path, text):
    found = extract_file(registry._extractors, "r", path, text.encode(), "h")
    return found, {(n["label"], n["id"].split("::", 1)[1]) for n in found.nodes}, {(s.split("::", 1)[1], k, t.split("::", 1)[-1]) for s, t, k, _ in found.edges}


PY = '''class A(models.Model):
    """Doc
    of A."""
    X = 1

    @staticmethod
    @app.task
    def run(a, b=1) -> int:
        self.x()
        go(a); go(b); pkg.mod.call()

    class Meta:
        def m(self): pass

if True:
    def hidden(): pass

def test_it():
    "one" "two"
def test_it(): pass
'''


def test_python():
    found, nodes, edges = read("d/m.py", PY)
    assert nodes == {("File", "d/m.py"), ("Class", "d/m.py#A"), ("Method", "d/m.py#A.run"), ("Class", "d/m.py#A.Meta"), ("Method", "d/m.py#A.Meta.m"), ("Method", "d/m.py#test_it"), ("Method", "d/m.py#test_it@L20")}
    by = {n["id"].split("#")[-1]: n for n in found.nodes}
    assert by["A"]["docstring"] == "Doc\nof A." and by["A"]["stereotypes"] == ["django_model"] and by["A"]["signature"] == "class A(models.Model)"
    assert by["A.run"]["modifiers"] == ["static"] and by["A.run"]["stereotypes"] == ["celery_task"] and by["A.run"]["return_type"] == "int" and by["A.run"]["signature"] == "def run(a, b=1) -> int"
    assert "docstring" not in by["test_it"] and by["test_it"]["stereotypes"] == ["test"]
    assert {t for s, k, t in edges if k == "CALLS"} == {"A.x", "go", "pkg.mod.call"} and ("d/m.py#A", "DECLARES", "d/m.py#A.Meta") in edges


def test_python_blank_and_broken():
    assert [n["label"] for n in read("a.py", " \n")[0].nodes] == ["File"]
    assert read("a.py", "def f(:\n")[0].errors and not read("a.py", "def f(:\n")[0].nodes


JAVA = """package com.x;
/** Svc. */
@RestController
public abstract class S<T extends Comparable<T>> extends Base<T> implements A, b.C {
  private Map<String, List<Integer>> m = new HashMap<>(), other;
  // a note
  /** Runs { it. */
  @Test
  @GetMapping(value = "/x(")
  public <R> List<R> run(Map<String,Integer> a, final int[] b, String... rest) throws E {
    run2(); this.run2(); S.run2(); log.info("}", a.b(c)); new S(); helper.go(); helper.go(1);
    int[] q = {1, 2};
    return null;
  }
  void run2() { }
  void run2(int a) { }
  abstract int none();
  enum Kind implements Z { ONE(1), TWO { }; int v; Kind(int v) { } }
  interface In extends P, Q { int f(); }
}
"""


def test_java():
    found, nodes, edges = read("S.java", JAVA)
    by = {n["id"].split("::", 1)[1]: n for n in found.nodes}
    assert {"com.x.S.run(Map<String,Integer>,int[])", "com.x.S.run2()", "com.x.S.run2(int)", "com.x.S.none()", "com.x.S.m", "com.x.S.other", "com.x.S.Kind", "com.x.S.Kind.v", "com.x.S.Kind.Kind(int)", "com.x.S.In", "com.x.S.In.f()", "com.x"} <= set(by)
    run = by["com.x.S.run(Map<String,Integer>,int[])"]
    assert run["docstring"] == "Runs { it." and run["stereotypes"] == ["test", "endpoint"] and run["return_type"] == "List<R>" and run["code"].endswith("}")
    assert by["com.x.S"]["stereotypes"] == ["rest_controller"] and by["com.x.S.Kind"]["stereotypes"] == ["enum"] and by["com.x.S.m"]["properties"]["field_type"] == "Map<String,List<Integer>>"
    assert {("com.x.S", "EXTENDS", "com.x.Base"), ("com.x.S", "IMPLEMENTS", "com.x.A"), ("com.x.S", "DECLARES", "com.x.S.Kind"), ("com.x.S", "IN_PACKAGE", "com.x"), ("com.x.S.In", "EXTENDS", "com.x.P"), ("S.java", "CONTAINS", "com.x.S.In")} <= edges
    assert not any(t.endswith(".C") for _, k, t in edges if k == "IMPLEMENTS")
    calls = {t for s, k, t in edges if k == "CALLS"}
    assert "com.x.S.run2()" in calls and any(t.endswith("::ref:log.info") for t in calls) and sum(t.endswith("::ref:helper.go") for t in calls) == 1


CS = """using System;
namespace A.B;
/// <summary>Does it.</summary>
[Serializable]
public partial class C : Base<int>, IThing, Other
{
    private readonly int a = 1, b;
    public string Name { get; set; } = "x";
    public int Twice => a * 2;
    public C(int a) : base(a) { }
    /// Finds.
    [Fact]
    public async Task<Dictionary<string, int>> Find<T>(string k, int n = 1) where T : class { return null; }
    public enum E { One }
    interface IIn { void M(int a); }
}
"""


def test_csharp():
    found, nodes, edges = read("C.cs", CS)
    by = {n["id"].split("::", 1)[1]: n for n in found.nodes}
    assert {"A.B", "A.B.C", "A.B.C.a", "A.B.C.b", "A.B.C.Name", "A.B.C.Twice", "A.B.C.C", "A.B.C.Find", "A.B.C.E", "A.B.C.IIn", "A.B.C.IIn.M"} == set(by) - {"C.cs"}
    assert by["A.B"]["name"] == "B" and by["A.B.C.Find"]["return_type"] == "Task<Dictionary<string, int>>" and by["A.B.C.Find"]["modifiers"] == ["public", "async"] and by["A.B.C.Find"]["stereotypes"] == ["test"]
    assert by["A.B.C.Name"]["modifiers"] == ["public", "property"] and by["A.B.C"]["docstring"] == "Does it." and by["A.B.C.E"]["stereotypes"] == ["enum"]
    heritage = {(k, t) for s, k, t in edges if k in ("EXTENDS", "IMPLEMENTS")}
    assert {("EXTENDS", "Base"), ("IMPLEMENTS", "IThing"), ("IMPLEMENTS", "Other")} == heritage
    assert read("D.cs", "class D { ")[0].errors


TS = """import x from 'y';
export interface P { a: string }
namespace N { function no() {} }
/** Sum. */
export default function sum(a: number, b = 2): number {
  const [s] = useState(0);
  return a + b;
}
const wrap = memo(forwardRef((props: P) => {
  useCustom();
  return <b>{"}"}</b>;
}));
export class K extends Z {
  private y = 1;
  constructor(private a: string) { super(); }
  static async load(id: string): Promise<void> {
    if (id) { useState(1); }
  }
}
const plain = 3
const later = async x => x + 1
describe('group of', () => { it('works', () => {}) })
export { wrap as w };
"""


def test_typescript():
    found, nodes, edges = read("a/mod.tsx", TS)
    by = {n["id"].split("#")[-1]: n for n in found.nodes}
    assert {"P", "N", "sum", "wrap", "K", "K.constructor", "K.load", "later", "useState", "useCustom", "mod_describe_group_of"} == set(by) - {"r::a/mod.tsx"}
    assert by["sum"]["return_type"] == "number" and by["sum"]["docstring"] == "Sum." and by["K.load"]["modifiers"] == ["static", "async"] and by["later"]["modifiers"] == ["async"]
    assert by["K.load"]["return_type"] == "Promise<void>" and by["wrap"]["signature"] == "const wrap = (props: P) =>"
    exports = {(t.split("#")[1], p["export_type"]) for _, t, k, p in found.edges if k == "EXPORTS"}
    assert exports == {("P", "named"), ("sum", "default"), ("wrap", "named"), ("K", "named")}
    hooks = {(s.split("#")[1], t.split("#")[1]) for s, t, k, _ in found.edges if k == "USES_HOOK"}
    assert hooks == {("sum", "useState"), ("wrap", "useCustom"), ("K.load", "useState")}


def test_distributed_run_with_odd_rows(spark):
    rows = [("r", "a.py", b"x = 1\n", "h"), ("r", "b.py", None, None), ("r", None, b"x", None), (None, "c.java", b"class C { int a; }", None), ("r", "d.txt", b"x", None), ("r", "e.py", b"\xff\xfe", None)]
    df = spark.createDataFrame(rows, "repository string, file_path string, content binary, content_hash string")
    got = {r.file_path: (len(r.nodes), len(r.errors)) for r in registry.extract(df).collect()}
    assert got == {"a.py": (1, 0), "b.py": (1, 0), "c.java": (3, 0), "e.py": (0, 1)}


def test_tuple_types_of_csharp_methods():
    text = """namespace N { class K {
 public Task<(int a, string b)> F(int x, (int, int) y = default) { return null; }
 public (int, string) H() { return (1, "a"); }
 private (int a, string b) pair = (1, "x");
 private readonly Func<int, int> f = (x) => x;
 public K(int a) : base(a) { }
} }"""
    nodes = {x["name"]: x for x in csharp.extract("r", "a.cs", text).nodes if x["label"] not in ("Package", "Class")}
    assert sorted((x["label"], n) for n, x in nodes.items()) == [("Constructor", "K"), ("Field", "f"), ("Field", "pair"), ("Method", "F"), ("Method", "H")]
    assert nodes["F"]["return_type"] == "Task<(int a, string b)>" and nodes["H"]["return_type"] == "(int, string)"
    assert nodes["F"]["signature"] == "Task<(int a, string b)> F(int x, (int, int) y)" and nodes["f"]["modifiers"] == ["private", "readonly"]


def test_bounded_type_parameters_records_and_calls_of_java():
    text = 'package p; class A { record P(int a) {} <T extends Comparable<T>> T f(T a) { a.b().c(); new Foo().bar(); h(); this.h(); "x".length(); return q(a); } void h() {} }'
    found = java.extract("r", "A.java", text)
    nodes = {x["id"]: x for x in found.nodes}
    assert nodes["r::p.A.f(T)"]["signature"] == "T f(T a)" and not any(x["name"] == "P" for x in found.nodes)
    symbols = sorted(x["name"] for x in found.nodes if x["label"] == "Reference")
    assert symbols == ['"x".length', "a.b", "a.b().c", "new Foo().bar", "p.A.q"]
    assert [e for e in found.edges if e[1] == "r::p.A.h()"] == [("r::p.A", "r::p.A.h()", "HAS_METHOD", None), ("r::p.A.f(T)", "r::p.A.h()", "CALLS", None)]


def test_generators_and_function_values_of_scripts():
    text = "export function* gen(a: number) { yield 1; }\nconst g = function (a, b) { return a; };\nconst h = async (x: string): Promise<string[]> => { return []; };\nconst k: Handler = (q) => { return q; };\n"
    nodes = {x["name"]: x for x in script.extract("r", "a.ts", text).nodes}
    assert sorted(nodes) == ["g", "gen", "h", "k"]
    assert nodes["g"]["signature"] == "const g = (a, b) =>" and nodes["h"]["return_type"] == "Promise<string[]>" and nodes["k"]["return_type"] == "Handler"
