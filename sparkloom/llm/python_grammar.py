"""Lexer and grammar of Python 3, after its published full grammar.

The lexer gives one character a token. Line ends inside brackets fall away; a block by indentation comes out between « and », of which the opening one
stands for the line end before it, and a line end follows the closing one unless the statement goes on with else, elif, except or finally.
"""

from __future__ import annotations

import re

from sparkloom.llm.grammar import Grammar

# Keywords, those that are names elsewhere too, and operators.
WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "match case type".split()
AUGMENTED = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()
BINARY = "** // / % << >> & ^ == != <= >= < >".split()

PYTHON = Grammar(
    """
start: (STMTS | stmt)*
ident: 'id' | 'match' | 'case' | 'type'
names: ident (',' ident)*
dotted: ident ('.' ident)*
expr: 'lambda' lparams? ':' expr | disj ('if' disj 'else' expr)?
disj: inv (('and' | 'or') inv)*
inv: 'not'* arith (cmp arith)*
cmp: 'cmp' | 'in' | 'not' 'in' | 'is' 'not'?
arith: operand (('bin' | '+' | '-' | '*' | '**' | '@' | '|') operand)*
operand: ('+' | '-' | '~' | 'await')* atom (ARGS | INDEX | '.' ident)*
atom: ident | 'num' | 'str'+ | '...' | 'None' | 'True' | 'False' | PAREN | LIST | DICT
named: ident ':=' expr | expr
star: '*' arith | expr
exprs: star (',' star)* ','?
nstar: '*' arith | named
value: yield | exprs
yield: 'yield' ('from' expr | exprs)?
for: ('async'? 'for' targets 'in' disj ('if' disj)*)+
target: '*'? (base (('.' ident | INDEX) !'.' !INDEX !ARGS | ARGS &ARGS | ARGS &'.' | ARGS &INDEX | '.' ident | INDEX)+ !after | ident !'.' !INDEX !ARGS | TPAREN !'.' !INDEX !ARGS | TLIST !'.' !INDEX !ARGS)
base: ident | 'str'+ | PAREN | LIST | DICT
after: '.' | INDEX | ARGS
targets: target (',' target)* ','?
lparams: lparam (',' lparam)* ','?
lparam: '/' | '*' ident? | '**' ident | ident ('=' expr)?
param: '/' | '*' (ident (':' star)?)? | '**' ident (':' expr)? | ident (':' expr)? ('=' expr)?
key: ident '=' expr | '**' expr
pos: !keyed ('*' expr | named for?)
keyed: ident '=' | '**'
slice: expr? ':' expr? (':' expr?)? | nstar
small: 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') names | 'del' targets | 'assert' expr (',' expr)? | import | 'type' ident TPARAMS? '=' expr | (targets &'=' '=')+ value | target (':' expr ('=' value)? | 'aug' value) | value
import: 'import' dotted ('as' ident)? (',' dotted ('as' ident)?)* | 'from' (('.' | '...')+ dotted? | dotted) 'import' ('*' | IMPORTS | alias (',' alias)*)
alias: ident ('as' ident)?
line: small (';' small)* ';'?
suite: BLOCK 'n'? | line 'n'
withitem: expr ('as' target)?
def: ('@' named 'd')* ('async'? 'def' ident TPARAMS? PARAMS ('->' expr)? ':' suite | 'class' ident TPARAMS? ARGS? ':' suite)
else: 'else' ':' suite
except: 'except' '*'? (expr ('as' ident)?)? ':' suite
stmt: 'if' named ':' suite ('elif' named ':' suite)* else? | 'while' named ':' suite else? | 'async'? 'for' targets 'in' exprs ':' suite else? | 'try' ':' suite (except+ else? ('finally' ':' suite)? | 'finally' ':' suite) | 'async'? 'with' (WITHS &':' | withitem (',' withitem)*) ':' suite | def | 'match' exprs ':' CASES 'n'? | line 'n'
case: 'case' pattern (',' pattern)* ','? ('if' named)? ':' suite
pattern: '*' ident | closed ('|' closed)* ('as' ident)?
closed: '-'? 'num' (('+' | '-') 'num')? | 'str'+ | 'None' | 'True' | 'False' | dotted PATTERNS? | PATTERNS | PATLIST | PATMAP
""",
    """
PAREN: ( (yield | nstar (for | (',' nstar)* ','?))?
ARGS: ( (pos (',' pos)* (',' key (',' (key | '*' expr))*)? ','? | key (',' (key | '*' expr))* ','?)?
TPAREN: ( (target (',' target)* ','?)?
PARAMS: ( (param (',' param)* ','?)?
IMPORTS: ( alias (',' alias)* ','?
WITHS: ( withitem (',' withitem)* ','?
PATTERNS: ( ((ident '=')? pattern (',' (ident '=')? pattern)* ','?)?
LIST: [ (nstar (for | (',' nstar)* ','?))?
INDEX: [ slice (',' slice)* ','?
TLIST: [ (target (',' target)* ','?)?
TPARAMS: [ ('*' | '**')? ident (':' expr)? ('=' expr)? (',' ('*' | '**')? ident (':' expr)? ('=' expr)?)* ','?
PATLIST: [ (pattern (',' pattern)* ','?)?
DICT: { (expr ':' expr for | (expr ':' expr | '**' arith) (',' (expr ':' expr | '**' arith))* ','? | nstar (for | (',' nstar)* ','?))?
PATMAP: { ((pattern ':' pattern | '**' ident) (',' (pattern ':' pattern | '**' ident))* ','?)?
BLOCK: « (STMTS | stmt)+
CASES: « case+
""",
    """
STMTS: stmt+
""",
    "n",
)

_DIGITS = r"\d(?:_?\d)*+"
_STRING = r"(?i:[rub]|f|br|rb|fr|rf)?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+'''|\"(?:[^\\\"\n]|\\.)*+\"|'(?:[^\\'\n]|\\.)*+')"
_TOKEN = re.compile(
    rf"(?:[ \t\f]|\\\n)*+((?:#[^\n]*+)?\n(?:[ \t\f]*+(?:#[^\n]*+)?\n)*+[ \t\f]*+|{_STRING}|[^\W\d]\w*+|0(?:[xX](?:_?[0-9a-fA-F])++|[oO](?:_?[0-7])++|[bB](?:_?[01])++)(?!\w)"
    rf"|(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.)(?:[eE][+-]?{_DIGITS})?|{_DIGITS}[eE][+-]?{_DIGITS}|{_DIGITS}(?=[jJ])|[1-9](?:_?\d)*+|0(?:_?0)*+)[jJ]?(?!\w)"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%@&|^=!<>:]=|\*\*|//|>>|<<|->|[-+*/%@&|^~<>=:;.,()\[\]{}]|(?s:.))",
    re.S,
)
_HEAD = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*")
_COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")
_LINE, _BAD = "\n", "\0"


class _Classes(dict):
    """Token -> its character; filled as tokens come."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.of = PYTHON.terminals
        self.fixed = {w: self.of[w] for w in [*WORDS, *SOFT]} | {a: self.of["aug"] for a in AUGMENTED}
        self.fixed |= {o: self.of["bin"] for o in BINARY if o not in ("**", "==", "!=", "<=", ">=", "<", ">")} | {o: self.of["cmp"] for o in ("==", "!=", "<=", ">=", "<", ">")}
        self.fixed["/"] = self.of["/"]

    def __missing__(self, t: str) -> str:
        c = t[0]
        if t in self.fixed:
            k = self.fixed[t]
        elif c in "#\n":
            k = _LINE
        elif t[-1] in "\"'" and len(t) > 1:
            k = self.of["str"] if not ("b" in t[:2].lower() and not t.isascii() and t[:2].strip("rRbB")[:1] in ("'", '"', "")) else _BAD
        elif c == "_" or c.isalpha() or not c.isascii() and t.isidentifier():
            k = self.of["id"] if t.isidentifier() else _BAD
        elif c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            k = self.of["num"]
        else:
            k = self.of.get(t, _BAD) if t not in ("«", "»") else _BAD
        if len(self) > self.most:
            self.clear()
        self[t] = k
        return k


_CLASSES = _Classes()
_N, _D, _IN, _OUT, _AT = (PYTHON.char(t) for t in ("n", "d", "«", "»", "@"))
_OPENING, _CLOSING = [PYTHON.char(t) for t in "([{"], [PYTHON.char(t) for t in ")]}"]
_GOES_ON = frozenset(PYTHON.char(t) for t in ("else", "elif", "except", "finally"))
_depths: dict[str, int] = {}


def _depth(line: str) -> int:
    d = _depths.get(line)
    if d is None:
        if len(_depths) > 200_000:
            _depths.clear()
        d = _depths[line] = sum(map(line.count, _OPENING)) - sum(map(line.count, _CLOSING))
    return d


def decoded(source: bytes) -> str:
    """The text of a file by its declaration of an encoding, else as UTF-8; raises ValueError where it is none."""
    if source.startswith(b"\xef\xbb\xbf"):
        return source[3:].decode("utf-8")
    for line in source.split(b"\n", 2)[:2]:
        m = _COOKIE.match(line)
        if m:
            return source.decode(m[1].decode("ascii"))
        if line.strip() and not line.lstrip().startswith(b"#"):
            break
    return source.decode("utf-8")


def _columns(blank: str) -> tuple[int, int]:
    """The columns of an indentation with tabs to multiples of eight, and with tabs as one."""
    if "\t" not in blank and "\f" not in blank:
        return len(blank), len(blank)
    a = b = 0
    for c in blank:
        if c == "\t":
            a, b = a // 8 * 8 + 8, b + 1
        elif c == "\f":
            a = b = 0
        else:
            a, b = a + 1, b + 1
    return a, b


def lex(source: bytes) -> str:
    """One character a token; raises ValueError if the bytes are no tokens of Python."""
    text = decoded(source)
    if "\0" in text:
        raise ValueError("null character")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.endswith("\n"):
        text += "\n"
    head = _HEAD.match(text).end()
    first = text[text.rfind("\n", 0, head) + 1 : head]
    found = _TOKEN.findall(text, head)
    chars = "".join(map(_CLASSES.__getitem__, found))
    if _BAD in chars:
        raise ValueError("no token")
    blanks = [first, *(t[t.rfind("\n") + 1 :] for t in found if t[0] in "#\n")]
    out: list[str] = []
    stack, depth = [(0, 0)], 0
    lines = chars.split(_LINE)
    for i, line in enumerate(lines[:-1]):
        if not depth and line:
            at = _columns(blanks[i])
            top = stack[-1]
            if at != top:
                if (at[0] > top[0]) != (at[1] > top[1]):
                    raise ValueError("tabs")
                if at[0] > top[0]:
                    stack.append(at)
                    if out and out[-1] == _N:
                        out.pop()
                    out.append(_IN)
                else:
                    while stack[-1][0] > at[0]:
                        stack.pop()
                        out += (_OUT, _N)
                    if stack[-1] != at:
                        raise ValueError("indentation")
                    if line[0] in _GOES_ON:
                        out.pop()
        out.append(line)
        depth = max(0, depth + _depth(line))
        if not depth and line:
            out.append(_D if line[0] == _AT else _N)
    out += [x for _ in stack[1:] for x in (_OUT, _N)]
    return "".join(out)
