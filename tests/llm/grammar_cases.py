"""Well-formed and broken one-file texts of the languages that ``foreign`` parses."""

VALID = {
    "c": [
        "int main(void) { return 0; }",
        'void f(void) { asm volatile("nop" : : "r"(x) : "memory"); }',
        "int x = ((struct p){1, 2}).a;",
        "int y = (struct p){.a = 1, .b = 2}.a;",
        "#if defined(A) && B > 2\nint a;\n#elif C\nint b;\n#else\nint c;\n#endif\n",
        "typedef int (*cmp)(const void *, const void *);",
        "static inline unsigned long long f(const char *restrict s) { return *s ? 1ull : 0; }",
        "struct a { int x : 3; unsigned : 2; struct { int y; } in; union { float f; int i; }; int tail[]; };",
        "enum e { A, B = 1 << 2, C, };",
        "int a[3][4] = { {1, 2}, [2] = {3}, };",
        "void f(int n, int v[static n]) { for (int i = 0, j = n; i < j; i++, j--) v[i] ^= v[j]; }",
        "int f(void) { label: if (x) goto label; else do { x--; } while (x > 0); switch (x) { case 1: case 2: break; case 3 ... 5: return 2; default:; } return (int)sizeof(struct a); }",
        "extern int printf(const char *fmt, ...) __attribute__((format(printf, 1, 2)));",
        "int (*table[])(int) = { f, g };",
        "char *s = \"a\" \"b\" L\"c\";",
        "void f() { int (*p)[3] = &a; (*p)[1] = 2; p->q->r(1)(2)[3]++; }",
        "#define MAX(a, b) \\\n  ((a) > (b) ? (a) : (b))\nint z = MAX(1, 2);",
        "_Static_assert(sizeof(int) == 4, \"size\");\n_Bool b = 1; _Atomic int c;",
        "int f(a, b) int a; char b; { return a + b; }",
        "void f(void) { char c = '\\''; unsigned u = 0x1Fu; double d = 1.5e-3, e = .5f, h = 0x1p-3; }",
        "void *p = (void *)0; size_t n = sizeof *p, m = _Alignof(int);",
        "static const struct ops o = { .open = my_open, .read = NULL, .list = { 1, 2, 3 } };",
        "void f(void) { if (a) if (b) c(); else d(); while (*p++ = *q++) ; }",
        "unsigned f(unsigned);\nunsigned f(unsigned x) { return ~x & -x | !x; }",
        "void f(void) { __asm__(\"cli\"); int x = ({ int y = 1; y + 2; }); }",
    ],
    "cpp": [
        "class A { public: A() : x(0), y{1} {} ~A(); explicit operator bool() const { return true; } private: int x, y; };",
        "A::A(int a) : B(a), c_(a) { run(); }",
        "A::~A() { delete[] p; }",
        "namespace a::b { int x; }",
        "namespace { void f(); }",
        "auto f = [&, n = 1](int x) mutable -> int { return x + n; };",
        "void f() { auto [a, b] = g(); for (const auto& [k, v] : m) { use(k, v); } }",
        "std::map<std::string, std::vector<std::pair<int, int>>> m;",
        "template <typename T, int N = 3> struct V { T data[N]; template <class U> void f(U&& u) noexcept; };",
        "template <> int f<int>(int x) { return x; }",
        "using V = std::vector<int>; using namespace std;",
        "enum class E : int { A = 1, B };",
        "int operator+(const A& a, const A& b) { return a.x + b.x; }",
        "struct B : public A, private virtual C { void f() override final; virtual int g() = 0; B(const B&) = delete; B& operator=(B&&) = default; };",
        "void f() { try { throw std::runtime_error(\"x\"); } catch (const std::exception& e) { log(e.what()); } catch (...) { throw; } }",
        "constexpr int sq(int x) { return x * x; } static_assert(sq(2) == 4);",
        "int x = static_cast<int>(3.5); auto p = std::make_unique<Foo>(1, 2); Foo* q = new Foo{1}; int* r = new int[4];",
        "void f() { if (auto it = m.find(k); it != m.end()) { return; } while (int x = next()) {} }",
        "std::vector<int> v = {1, 2, 3}; std::vector<int> w{1, 2}; Foo bar(1, 2);",
        "[[nodiscard]] int f() noexcept(true); extern \"C\" { int g(int); }",
        "auto s = R\"x(raw \" text)x\"; auto t = u8\"é\"; int b = 0b1'000;",
        "void A<T>::f(T&& t) const& { this->g(std::forward<T>(t)); (*this)(); }",
        "template <typename... Ts> void f(Ts&&... ts) { (g(ts), ...); h(std::forward<Ts>(ts)...); }",
        "std::ostream& operator<<(std::ostream& o, const A& a) { return o << a.x << std::endl; }",
        "static int counter = 0; int A::count = 0; const char* const names[] = { \"a\", \"b\" };",
    ],
    "javascript": [
        "const re = /ab+c[/]/gi; if (re.test(s)) { x = a / b / c; }",
        "class A extends B { #p = 1; static s = 2; constructor(x) { super(x); this.#p = x; } get v() { return this.#p; } static async *gen() { yield* other(); } }",
        "const o = { a, b: 1, f(x) { return x; }, get g() { return 1; }, async h() {}, *i() {}, ['k' + 1]: 2, ...rest, 'q': 3, 4: 5 };",
        "export default function () { return `a ${b + `c ${d}`} e`; }",
        "import a, { b as c, d } from './x.js'; import * as e from \"y\"; export { a, c as default }; export * from 'z';",
        "for (const [k, v] of Object.entries(o)) console.log(k, v);",
        "const f = async (a, { b = 1, ...c } = {}, [d, , e]) => { await g(a); };",
        "let x = a ?? b?.c?.[0]?.(1); x ||= 2; x **= 3; y = x ** 2;",
        "label: for (var i = 0; i < 3; i++) { if (i) continue label; else break label }",
        "var a = function* () { const x = yield 1; return x }\nvar b = new Foo\nvar c = new a.b.C(1)",
        "switch (x) { case 'a': { f(); break } default: g() }",
        "try { f() } catch { g() } finally { h() }",
        "(function () { 'use strict'; })(); (() => {})(); !function () {}();",
        "const t = tag`x${1}`; const u = typeof x === 'undefined' ? void 0 : delete o.p;",
        "if (a) b(); else if (c) d(); else { e() }\ndo { x-- } while (x > 0)",
        "const big = 10n, hex = 0xff, oct = 0o7, bin = 0b1, f = .5, g = 1_000;",
        "async function f() { for await (const x of y) { } return await Promise.all([a, b]) }",
        "a = b\n++c\nlet d = [1, , 2, ...e]",
        "module.exports = { f: (a) => ({ b: a }), g: a => a.c };",
        "return_value = x => x in o && x instanceof C;",
        "function f(a = 1, ...r) { return r.length > a }\n",
        "const { a: { b }, c = 2 } = o; [x, y] = [y, x];",
        "export const f = () => {}, g = 2; export class K {}",
        "s = x.replace(/[\"'\\/]/g, (m) => map[m]).split(/\\s+/);",
        "with_default = cond ? { a: 1 } : [1, 2];",
    ],
}
BROKEN = {
    "c": [
        "int main(void) { return 0;", "int f( { return", "int x = ;", "void f() { if (x }", "struct a { int x", "int a[3 = {1};", "void f(void) { x = y z; }", "just some words", "int f() { return 1 }", "#if A\nint x;\n", "#endif\nint x;", "void f() { for (i = 0; i < 3) }", 'char *s = "open;', "/* open", "void f() { else x; }",
        "int f(void) { a + ; }", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b", "int 3x;", "fn main() {}", "void f() { (a + b; }", "enum e { A, B", "void f() { case 1 x; }", "int f(int a, ) { }", "}", "void f() { do { x(); } }",
    ],
    "cpp": [
        "class A { public: A( : x(0) {} };", "namespace a {", "template <typename T struct V {};", "auto f = [&(int x) { return x; };", "class A : public { };", "void f() { try { } }", "int x = static_cast<int(3);", "using = int;", "enum class E { A B };", "A::A() : x(1 { }", "void f() { for (auto x : ) {} }", "struct B { void f() override }",
        "std::vector<int v;", "void f() { throw ; ; ) }", "template <> {", "int operator(int);", "class { int x; }", "void f() { new ; }", "catch (...) {}", "void f() { return return; }", "just some words here", "auto x = ;", "int f() { 'ab }", "fn main() { let x = 1; }", "namespace a::b::",
    ],
    "javascript": [
        "const = 1;", "function f( { }", "let x = ;", "if (a { b() }", "class A { constructor( { } }", "const o = { a: };", "x = [1, 2", "f(1, 2", "`open ${a", "'open", "for (let i = 0; i < 3) {}", "return => 1 2", "a b c", "const f = (a, => a;", "switch (x) { foo() }", "try { f() }", "import { a from 'b';", "export default", "x = a ? b;",
        "} else {", "class extends { ", "var 1a = 2;", "a.b.", "/open", "async function { }",
    ],
}
