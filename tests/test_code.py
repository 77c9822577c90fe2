import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.operators.facts import facts_of
from basalt.operators.patterns import PatternError, compile_pattern
from basalt.plans.scan import Options, scan
from basalt.rules import RuleError, built_in, checked
from basalt.sources.files import files_from_table

BAD = {
    "js.crypto.weak-hash": "const h = crypto.createHash('md5').update(x)",
    "js.crypto.create-cipher": "crypto.createCipher('aes', key)",
    "js.dangerous.eval": "eval(code)",
    "js.dangerous.child-process-exec": "cp.exec(cmd)",
    "js.dangerous.child-process-exec-sync": "child_process.execSync(cmd)",
    "js.dangerous.new-function": "const f = new Function(body)",
    "js.dangerous.vm-run": "vm.runInThisContext(code)",
    "js.taint.sql-injection": "function v(req) { const q = 'select ' + req.query.id; conn.query(q) }",
    "js.taint.command-injection": "app.get('/', (req, res) => { child_process.exec('ls ' + req.body.dir, done) })",
    "js.xss.document-write": "document.write(text)",
    "js.xss.inner-html": "el.innerHTML = text",
    "js.xss.outer-html": "el.outerHTML = text",
    "js.xss.insert-adjacent-html": "el.insertAdjacentHTML('beforeend', text)",
    "py.crypto.weak-hash-md5": "hashlib.md5(x)",
    "py.crypto.weak-hash-sha1": "hashlib.sha1(x)",
    "py.crypto.weak-hash-new": "hashlib.new('md5', x)",
    "py.crypto.requests-no-verify": "requests.get(url, verify=False)",
    "py.crypto.ssl-unverified-context": "ssl._create_unverified_context()",
    "py.dangerous.os-system": "os.system(cmd)",
    "py.dangerous.eval": "def f(e):\n    return eval(e)",
    "py.dangerous.yaml-load": "yaml.load(f)",
    "py.dangerous.exec": "exec(code)",
    "py.dangerous.tempfile-mktemp": "tempfile.mktemp()",
    "py.deser.pickle-load": "pickle.load(f)",
    "py.deser.pickle-loads": "pickle.loads(b)",
    "py.deser.marshal-loads": "marshal.loads(b)",
    "py.deser.yaml-unsafe-load": "yaml.unsafe_load(f)",
    "py.deser.jsonpickle": "jsonpickle.decode(s)",
    "py.flask.debug-run": "app.run(host='x', debug=True)",
    "py.django.raw-sql": "User.objects.raw(sql)",
    "py.xss.flask-markup": "mark_safe(text)",
    "py.taint.sql-injection": "def v():\n    q = 'select ' + request.args.get('id')\n    cursor.execute(q)",
    "py.taint.command-injection": "os.system('ping ' + request.args.get('host'))",
    "py.injection.subprocess-shell-true": "subprocess.run(cmd, shell=True)",
    "py.injection.os-popen": "os.popen(cmd)",
    "py.injection.subprocess-getoutput": "subprocess.getoutput(cmd)",
}
GOOD = """import ast, hashlib
ast.literal_eval(x)
hashlib.sha256(x)
hashlib.new('sha256', x)
requests.get(url, verify=True)
requests.get(url, verify=False, timeout=3)
ssl.create_default_context()
yaml.safe_load(f)
subprocess.run([a, request.args.get('host')])
cursor.execute('select %s', [request.args.get('id')])
app.run()
def v():
    q = request.args.get('id')
    cursor.execute(f(q))
"""
GOOD_JS = """crypto.createHash('sha256')
crypto.createCipheriv('aes', key, iv)
JSON.parse(text); el.textContent = text; execFile('ls', [req.query.dir])
conn.query('select ?', [req.query.id])
const re = /eval(x)/g; const s = "eval(y)"; // eval(z)
"""
TAINT = {
    "direct": ("def v():\n    q = request.args.get('id')\n    cursor.execute(q)\n", 1),
    "reassigned": ("def v():\n    q = request.args.get('id')\n    q = 'safe'\n    cursor.execute(q)\n", 0),
    "one_branch": ("def v(c):\n    q = request.args.get('id')\n    if c:\n        q = int(q)\n    cursor.execute(q)\n", 1),
    "both_branches": ("def v(c):\n    q = request.args.get('id')\n    if c:\n        q = int(q)\n    else:\n        q = int(q)\n    cursor.execute(q)\n", 0),
    "loop": ("def v():\n    q = ''\n    for it in request.args.getlist('x'):\n        q = it\n    cursor.execute(q)\n", 1),
    "loop_carried": ("def v():\n    a = b = ''\n    while x:\n        cursor.execute(a)\n        a = b\n        b = request.args.get('x')\n", 1),
    "container": ("def v():\n    arr = []\n    arr.append(request.args.get('x'))\n    cursor.execute(arr[0])\n", 1),
    "summary": ("def wrap(u):\n    return u + ''\ndef v():\n    cursor.execute(wrap(request.args.get('id')))\n", 1),
    "summary_of_summary": ("def a(u):\n    return b(u)\ndef b(u):\n    return u\ndef v():\n    cursor.execute(a(request.args.get('id')))\n", 1),
    "summary_without_flow": ("def wrap(u):\n    return 1\ndef v():\n    cursor.execute(wrap(request.args.get('id')))\n", 0),
    "field": ("def v():\n    x.a = request.args.get('id')\n    cursor.execute(x.a)\n", 1),
    "format": ("def v():\n    q = request.args.get('id')\n    cursor.execute(f'select {q}')\n", 1),
    "try": ("def v():\n    q = ''\n    try:\n        q = request.args.get('id')\n    except E:\n        pass\n    cursor.execute(q)\n", 1),
    "augmented": ("def v():\n    q = 'select '\n    q += request.args.get('id')\n    cursor.execute(q)\n", 1),
    "destructured": ("def v():\n    a, b = request.args.get('id')\n    cursor.execute(b)\n", 1),
}


def scanned(spark, files, **options):
    table = files_from_table(spark.createDataFrame(list(files.items()), "p string, c string"), F.col("p"), F.col("c"))
    rows = scan(table, Options(**options)).collect()
    return sorted((r["location"]["path"], r["location"]["start_line"], r["rule_id"]) for r in rows), rows


def test_every_rule_fires_on_its_bad_file_and_on_no_good_one(spark):
    suffix = lambda rule: ".py" if rule.startswith("py.") else ".js"
    assert sorted(BAD) == sorted(r["id"] for r in built_in())
    files = {rule + suffix(rule): text for rule, text in BAD.items()} | {"good.py": GOOD, "good.js": GOOD_JS, "good.ts": GOOD_JS}
    found, _ = scanned(spark, files)
    fired = {(path, rule) for path, _, rule in found}
    assert {(rule + suffix(rule), rule) for rule in BAD} <= fired
    assert not [x for x in fired if x[0].startswith("good")]


def test_taint(spark):
    found, rows = scanned(spark, {f"{name}.py": text for name, (text, _) in TAINT.items()}, passes=("taint",))
    counts = {name: sum(path == f"{name}.py" for path, _, _ in found) for name in TAINT}
    assert counts == {name: n for name, (_, n) in TAINT.items()}
    flow = next(r for r in rows if r["location"]["path"] == "direct.py")["data_flow"]
    assert "source" in flow[0]["message"] and flow[0]["location"]["start_line"] == 2 and "sink" in flow[-1]["message"] and flow[-1]["location"]["start_line"] == 3


def test_flows_through_long_chains_keep_their_steps(spark):
    """Twelve functions that call each other, two that call each other in turn, and twenty assignments in a row."""
    chain = "".join(f"def f{n}(u):\n    return f{n + 1}(u)\n" for n in range(12)) + "def f12(u):\n    return u\n"
    both = "def odd(u):\n    if u:\n        return even(u)\n    return 0\ndef even(u):\n    if u:\n        return odd(u)\n    return u\n"
    body = "    a0 = f0(odd(request.args))\n" + "".join(f"    a{n + 1} = a{n}\n" for n in range(20)) + "    cursor.execute(a20)\n    cursor.execute(g(a20))\n    cursor.execute(int(a20))\n"
    found, rows = scanned(spark, {"a.py": chain + both + "def v():\n" + body}, passes=("taint",))
    assert [(p, r) for p, _, r in found] == [("a.py", "py.taint.sql-injection")]
    lines = [step["location"]["start_line"] for step in rows[0]["data_flow"]]
    first = (chain + both).count("\n") + 2
    assert lines == [first, *range(first, first + 21), first + 21]  # the source, 21 assignments, the sink


def test_javascript_destructuring_and_types(spark):
    found, _ = scanned(spark, {"d.js": "function v(req) {\n  const { id } = req.query;\n  conn.query(id);\n}\n", "t.ts": "const q: string = req.query.id as string;\nasync function f(a: number): Promise<void> { await g<number>(a); }\nconn.query(q)\n"}, passes=("taint",))
    assert [(p, n) for p, n, _ in found] == [("d.js", 3), ("t.ts", 3)]


def test_suppression_needs_a_reason(spark):
    text = "eval(a)  # basalt:ignore py.dangerous.eval -- fixed\neval(b)\n\neval(c)  # basalt:ignore py.dangerous.eval\neval(d)  # basalt:ignore py.other -- no\n"
    assert [n for _, n, _ in scanned(spark, {"a.py": text})[0]] == [4, 5]


def test_equal_files_are_read_once_and_reported_twice(spark):
    assert [p for p, _, _ in scanned(spark, {"a.py": "eval(x)\n", "b/a.py": "eval(x)\n"})[0]] == ["a.py", "b/a.py"]


def test_broken_files_are_read_as_far_as_possible(spark):
    assert scanned(spark, {"a.py": "def f(:\n  x\n\neval(x)\n", "b.js": "function ( { \n eval(y)\n", "c.js": "'''"})[0][0] == ("a.py", 4, "py.dangerous.eval")


def test_options(spark):
    files = {"a.py": "eval(x)\nhashlib.md5(y)\n"}
    assert [r for *_, r in scanned(spark, files, disabled=("py.dangerous.eval",))[0]] == ["py.crypto.weak-hash-md5"]
    assert [r for *_, r in scanned(spark, files, min_confidence="HIGH")[0]] == ["py.crypto.weak-hash-md5"]
    with pytest.raises(ValueError):
        Options(min_confidence="SOME")


def test_own_passes(spark, monkeypatch):
    """A pass over files and one over facts, with rules of their own, beside a built-in one."""
    from basalt.model import CANDIDATE
    from basalt.plans import scan as S

    monkeypatch.setattr(S, "PASSES", dict(S.PASSES))
    rules = [{"id": i, "message": "m", "severity": "LOW", "confidence": "HIGH"} for i in ("own.long", "own.calls")]
    names = [part.split()[0] for part in CANDIDATE.split(", ")[:9]]
    place = {"path": "path", "engine": "'own'", "rule_id": "'own.long'", "seq": "1L", "start_line": "1", "start_col": "0", "end_line": "1", "end_col": "1", "value": "cast(null as string)"}
    flow = next(t for t in CANDIDATE.split("data_flow ")[1:])

    def longer(files, options):
        return files.where("length(content) > 12").selectExpr(*(f"{place[n]} as {n}" for n in names), f"cast(array() as {flow}) as data_flow")

    def calls(facts, patterns):
        one = place | {"rule_id": "'own.calls'", "seq": "id", **{n: n for n in ("start_line", "start_col", "end_line", "end_col")}}
        return facts.where("kind = 'call' and name = 'run'").selectExpr(*(f"{one[n]} as {n}" for n in names), f"cast(array() as {flow}) as data_flow")

    S.register_pass("long", S.Pass(longer, metadata=tuple(rules[:1])))
    S.register_pass("calls", S.Pass(calls, reads_code=True, metadata=tuple(rules[1:])))
    found, _ = scanned(spark, {"a.py": "run(eval(x))\nrun(y)\n", "b.py": "eval(z)\n"}, passes=("long", "patterns", "calls"))
    assert sorted((p, n, r) for p, n, r in found) == [("a.py", 1, "own.calls"), ("a.py", 1, "own.long"), ("a.py", 1, "py.dangerous.eval"), ("a.py", 2, "own.calls"), ("b.py", 1, "py.dangerous.eval")]
    with pytest.raises(ValueError):
        S.register_pass("taint", S.Pass(longer))
    with pytest.raises(ValueError):
        Options(passes=("nothing",))


def test_files_that_nest_too_deep_keep_what_was_read(spark):
    found, _ = scanned(spark, {"a.py": "eval(x)\ny = " + "-" * 3000 + "1\n"})
    assert ("a.py", 1, "py.dangerous.eval") in found


def test_no_files(spark):
    table = files_from_table(spark.createDataFrame([], "p string, c string"), F.col("p"), F.col("c"))
    assert scan(table).count() == 0


def test_a_metavariable_is_the_same_everywhere(spark):
    rule = checked({"id": "x.same", "languages": ["python"], "mode": "pattern", "severity": "LOW", "confidence": "LOW", "message": "m", "pattern": "same($A, $A)"})
    assert [n for _, n, _ in scanned(spark, {"a.py": "same(a, b)\nsame(a.b, a.b)\n"}, rules=[rule])[0]] == [2]


@pytest.mark.parametrize("text", ["a +", "if x: pass", "f($X, ..., g, ...)", "$X"])
def test_patterns_that_cannot_be_used(text):
    with pytest.raises(PatternError):
        compile_pattern(text)


@pytest.mark.parametrize("change", [{"pattern": None}, {"mode": "regex"}, {"mode": "taint"}, {"typo": 1}, {"severity": "BAD"}, {"id": ""}])
def test_rules_that_cannot_be_used(change):
    rule = {"id": "x", "languages": ["python"], "mode": "pattern", "severity": "LOW", "confidence": "LOW", "message": "m", "pattern": "f($X)"}
    with pytest.raises(RuleError):
        checked(rule | change)


def test_rule_counts():
    rules = built_in()
    assert len(rules) == 36 and sum(r["mode"] == "taint" for r in rules) == 4 and sum(len(r["pattern"]) for r in rules) == 51
    assert all(r.get("fix_suggestion") for r in rules)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc(){}[];,.=>'\"`$/\\\n :+?!<0#", max_size=60), st.sampled_from(["python", "javascript", "typescript"]))
def test_any_text_can_be_read(text, language):
    assert isinstance(facts_of(language, text), list)


@pytest.mark.parametrize("text", ["switch (x) {", "switch (x) { case 1:", "for (", "class A {", "`${", "if (a) {} else", "a = {", "f(" * 3000, "((((" * 500 + "x", "x = " + "a + " * 5000 + "b"])
def test_text_that_ends_too_soon(text):
    assert isinstance(facts_of("javascript", text), list) and isinstance(facts_of("python", text), list)
