"""Lexers and grammars of the languages whose files are judged.

The grammars follow the published language definitions: ECMAScript modules, TypeScript, Go, Rust and JSON. Names, types and
other early errors are not checked.
"""

from __future__ import annotations

import re

from sparkloom.llm.grammar import Grammar

# ---------------------------------------------------------------- JSON
JSON = Grammar(
    """
start: value
value: 'str' | 'num' | 'true' | 'false' | 'null' | ARR | OBJ
""",
    """
ARR: [ (value (',' value)*)?
OBJ: { ('str' ':' value (',' 'str' ':' value)*)?
""",
)
_JSON = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?)(?![\w.])|(true|false|null)(?!\w)|([\[\]{},:])|(\S))')

# ---------------------------------------------------------------- JavaScript, TypeScript
_JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false yield await".split()
_JS_SOFT = "async of get set static from as let".split()
_TS_SOFT = "type interface declare abstract readonly public private protected override namespace module keyof infer is asserts unique satisfies implements enum accessor out global".split()
_BIN = ["**", "*", "/", "%", "+", "-", "<<", "<", "<=", "==", "!=", "===", "!==", "&", "^", "|", "&&", "||", "??", "in", "instanceof"]
_ASSIGN = ["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="]


def _any(words) -> str:
    return " | ".join(f"'{w}'" for w in words)


def _ecma(ts: bool) -> Grammar:
    soft = [*_JS_SOFT, *(w for w in _TS_SOFT if ts and w != "enum")]
    words = [w for w in _JS_WORDS if w not in soft]
    ann = "(':' type)?" if ts else ""
    ret = "(':' rtype)?" if ts else ""
    tps = "tparams?" if ts else ""
    opt = "('?' | '!')?" if ts else ""
    productions = f"""
start: 'n'* (STMTS | ITEMS | item)*
item: import | export | stmt
end: ';' 'n'* | 'n'+ | $
ident: 'id' | {_any(soft)} | 'yield' | 'await'
prop: ident | {_any(words)} | 'priv'
name: prop | 'str' | 'num' | COMPUTED
pattern: ident | ARRAY | OBJECT
from: 'from' 'str' (('with' | 'assert') OBJECT)? end
import: 'import' !ARGS !'.' ('str' end | {"'type'? " if ts else ""}clause from{" | ident '=' expr end" if ts else ""})
clause: '*' 'as' ident | NAMED | ident (',' ('*' 'as' ident | NAMED))? &'from'
export: 'export' ('*' ('as' (prop | 'str'))? from | {"'type'? " if ts else ""}NAMED (from | end) | 'default' (fundecl | classdecl | {"'interface' ident tparams? ('extends' type (',' type)*)? OBJTYPE 'n'* | " if ts else ""}assign end) | decl{" | '=' expr end" if ts else ""})
decl: fundecl | classdecl | vardecl{" | tsdecl" if ts else ""}
vardecl: ('var' | 'let' &(ident | ARRAY | OBJECT) | 'const'{" !'enum'" if ts else ""}) binding (',' binding)* end
binding: pattern {"'!'? " + ann if ts else ""} ('=' assign)?
fundecl: 'async'? 'function' '*'? ident? {tps} PARAMS {ret} (BLOCK 'n'*{" | end" if ts else ""})
classdecl: decorator* {"'abstract'? " if ts else ""}'class' classtail 'n'*
classtail: (!'extends' {"!'implements' " if ts else ""}ident)? {tps} ('extends' operand)? {"('implements' type (',' type)*)?" if ts else ""} CLASSBODY
decorator: '@' ident ('.' prop)* ARGS? 'n'*
stmt: ';' 'n'* | BLOCK 'n'* | decl | 'if' COND 'n'* stmt ('n'* 'else' 'n'* stmt)? | 'for' 'await'? FORHEAD 'n'* stmt | 'while' COND 'n'* stmt | 'do' 'n'* stmt 'n'* 'while' COND (';' | 'n')* | 'return' expr? end | 'throw' expr end | 'break' (ident &end)? end | 'continue' (ident &end)? end | 'try' BLOCK 'n'* ('catch' PARAMS? BLOCK 'n'* ('finally' BLOCK)? | 'finally' BLOCK) 'n'* | 'switch' COND SWITCH 'n'* | 'debugger' end | ident ':' 'n'* stmt | !OBJECT !'function' !'class' expr end
expr: assign (',' assign)*
assign: operand (binop operand | '?' assign ':' assign | asop assign)*
binop: {_any(_BIN)} | '>' '>'? '>'? '='? 'n'?
asop: {_any(_ASSIGN)}
operand: prefix* primary postfix*
prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' &(prefix | primary) | 'new' !'.' | 'yield' '*'? &(prefix | primary)
primary: arrow | 'async'? 'function' '*'? ident? {tps} PARAMS {ret} BLOCK | 'class' classtail | 'this' | 'super' | 'null' | 'true' | 'false' | 'num' | 'str' | 'tpl' | 'regex' | 'import' (ARGS | '.' prop) | 'new' '.' prop | 'priv' &'in' | ident | PAREN | ARRAY | OBJECT{" | '<' type '>' operand" if ts else ""}
arrow: 'async'? {tps} PARAMS {ret} '=>' body | 'async'? ident '=>' body
body: BLOCK | assign
postfix: '.' prop | '?.' (prop | ARGS | INDEX) | INDEX | ARGS | 'tpl' | '++' | '--'{" | '!' | targs &(ARGS | 'tpl' | ';' | ',' | $ | 'n') | ('as' | 'satisfies') type" if ts else ""}
"""
    if ts:
        productions += f"""
tsdecl: 'declare' (decl | 'global' NAMESPACE 'n'*) | 'interface' ident tparams? ('extends' type (',' type)*)? OBJTYPE 'n'* | 'type' ident tparams? '=' type end | 'const'? 'enum' ident ENUM 'n'* | ('namespace' | 'module') (ident ('.' ident)* | 'str') NAMESPACE 'n'*
rtype: 'asserts'? (ident | 'this') 'is' type | type
type: utype ('extends' utype '?' type ':' type)?
utype: ('|' | '&')? ptype (('|' | '&') ptype)*
ptype: (('keyof' | 'readonly' | 'unique' | 'infer') &ptype)* tprim (TUPLE)*
tprim: 'abstract'? 'new'? tparams? PARAMS '=>' rtype | 'typeof' ident ('.' prop)* targs? | 'import' ARGS ('.' prop)* targs? | (ident | 'this') ('.' prop)* targs? | 'void' | 'null' | 'true' | 'false' | '-'? 'num' | 'str' | 'tpl' | TUPLE | OBJTYPE | TPAREN
targs: '<' type (',' type)* ','? '>'
tparams: '<' tparam (',' tparam)* ','? '>'
tparam: ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?
sep: ';' | ',' | 'n' | $
modifier: ('public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'get' | 'set' | 'accessor') &(name | '*')
"""
        param = "decorator* (('public' | 'private' | 'protected' | 'readonly' | 'override') &pattern)* ('...'? pattern | 'this') '?'? (':' type)? ('=' assign)?"
        member = f"decorator* modifier* '*'? name {opt} (tparams? PARAMS (':' rtype)? (BLOCK | end) | (':' type)? ('=' assign)? end) | modifier* INDEXSIG ':' type end | 'static' BLOCK"
        sig = "(('readonly' | 'get' | 'set') &name)* name '?'? (tparams? PARAMS (':' rtype)? | (':' type)?) | 'new'? tparams? PARAMS (':' rtype)? | (('+' | '-')? 'readonly')? INDEXSIG (('+' | '-')? '?')? ':' type"
        extra = f"""
TPAREN: ( type
TUPLE: [ ((('...')? ident '?'? ':' type | '...'? type '?'?) (',' ('...'? ident '?'? ':' type | '...'? type '?'?))* ','?)?
INDEXSIG: [ ident (':' type | 'in' type ('as' type)?)
OBJTYPE: {{ 'n'* (SIGS | sig sep*)*
ENUM: {{ (name ('=' assign)? (',' name ('=' assign)?)* ','?)?
NAMESPACE: {{ 'n'* (STMTS | ITEMS | item)*
"""
        productions += f"sig: {sig}\n"
    else:
        param = "'...'? pattern ('=' assign)?"
        member = "decorator* (('static' | 'async' | 'get' | 'set') &(name | '*'))* '*'? name (PARAMS BLOCK | ('=' assign)? end) | 'static' BLOCK"
        extra = ""
    productions += f"""
param: {param}
member: {member}
property: '...' assign | (('async' | 'get' | 'set') &(name | '*'))* '*'? name {tps} PARAMS {ret} BLOCK | name ':' assign | ident ('=' assign)?
arg: '...'? assign
init: ('var' | 'let' | 'const') pattern {ann} | operand
spec: {"'type'? " if ts else ""}(prop | 'str') ('as' (prop | 'str'))?
clauses: 'case' expr ':' 'n'* stmt* | 'default' ':' 'n'* stmt*
"""
    groups = f"""
COND: ( expr
PAREN: ( expr
ARGS: ( (arg (',' arg)* ','?)?
PARAMS: ( (param (',' param)* ','?)?
FORHEAD: ( init ('of' assign | 'in' expr) $ | (('var' | 'let' | 'const') binding (',' binding)* | expr)? ';' expr? ';' expr?
INDEX: [ expr
COMPUTED: [ assign
ARRAY: [ ','* (arg (','+ arg)* ','*)?
BLOCK: {{ 'n'* (STMTS | stmt)*
OBJECT: {{ (property (',' property)* ','?)?
CLASSBODY: {{ (';' | 'n' | MEMBERS | member)*
SWITCH: {{ 'n'* ((CLAUSES | clauses) (STMTS | stmt)*)*
NAMED: {{ (spec (',' spec)* ','?)?
{extra}"""
    # A declaration ends at its line; vardecl in a for head has no end of its own and is written out there.
    segments = f"""
STMTS: 'n'* stmt+
ITEMS: 'n'* item+
CLAUSES: 'n'* clauses+
MEMBERS: (';' | 'n' | member)+
{"SIGS: 'n'* (sig sep+)+" if ts else ""}"""
    return Grammar(productions, groups, segments, ";n")


JS, TS = _ecma(False), _ecma(True)

_ID = r"(?:[A-Za-z_$\x80-\U0010ffff]|\\u[0-9a-fA-F{}]+)(?:[\w$\x80-\U0010ffff]|\\u[0-9a-fA-F{}]+)*+"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+"
_OPS = r"===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%<>=!&|^~?:;,.@()\[\]{}]"
_ECMA = re.compile(
    rf"((?:[ \t\f\v\r\xa0﻿]|//[^\n]*+|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/)++)|((?:\n|/\*(?:[^*]|\*(?!/))*+\*/)++)|({_ID})"
    r"|((?:0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++|(?:\d[\d_]*+\.?(?:[\d_]*+)|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)n?(?![\w$]))"
    rf"|(\"(?:[^\"\\\n]|\\.|\\\n)*+\"|'(?:[^'\\\n]|\\.|\\\n)*+')|(`)|({_REGEX})|({_OPS})|(#{_ID})|(.)",
    re.S,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S)
_JS_ENDS = {"id", "num", "str", "tpl", "regex", ")", "]", "}", "++", "--", "this", "super", "null", "true", "false", "return", "break", "continue", "debugger", "yield", "priv", "void"}
_NO_BREAK_BEFORE = {"in", "instanceof", "from", "as", "of", "extends", "implements", "satisfies", "=>"}
_START = {"id", "num", "str", "regex", "priv", "{", "!", "~", "++", "--", "@", "[", "*"}


class Bad(Exception):
    """The text is no sequence of tokens of the language."""


def _lex_ecma(text: str, words: frozenset[str], soft: frozenset[str], depth: int = 0, ends: frozenset[str] = frozenset(_JS_ENDS)) -> list[str]:
    """Token classes; 'n' is a line end at which a statement may end."""
    out: list[str] = []
    at, n, breaks = 0, len(text), False
    match = _ECMA.match
    if text.startswith("#!"):
        at = (text.find("\n") + n + 1) % (n + 1)
    append = out.append
    while at < n:
        m = match(text, at)
        kind = m.lastindex
        at = m.end()
        if kind == 1:
            continue
        if kind == 2:
            breaks = True
            continue
        if kind == 3:
            w = m[3]
            c = w if w in words or w in soft else "id"
            if c in words and out and out[-1] in (".", "?."):
                c = "id"
        elif kind == 8:
            c = m[8]
        elif kind == 7:
            # After an operand, a slash divides.
            if out and (out[-1] in _JS_ENDS and out[-1] not in ("return", "yield", "void", "}", "break", "continue") or out[-1] in soft):
                at = m.start() + 1
                c = "/"
                if text.startswith("=", at):
                    c, at = "/=", at + 1
            else:
                c = "regex"
        elif kind == 4:
            c = "num"
        elif kind == 5:
            c = "str"
        elif kind == 6:
            # Embedded expressions come out as the arguments of calls of the template: ( expression ) each.
            parts: list[str] = []
            while True:
                m = _TEMPLATE.match(text, at)
                if not m or depth > 8:
                    raise Bad("template")
                at = m.end()
                if m[1] == "`":
                    break
                level, p = 1, at
                # The embedded expression ends at the brace that closes it; strings and templates in it are passed over.
                while level:
                    m2 = _EMBEDDED.search(text, p)
                    if not m2:
                        raise Bad("template")
                    p = m2.end()
                    if m2[0] == "{":
                        level += 1
                    elif m2[0] == "}":
                        level -= 1
                parts += ["(", *_lex_ecma(text[at : p - 1], words, soft, depth + 1, ends), ")"]
                at = p
            c = "tpl"
        elif kind == 9:
            c = "priv"
        else:
            raise Bad(m[0])
        if breaks:
            breaks = False
            if out and (out[-1] in ends or out[-1] in soft) and c not in _NO_BREAK_BEFORE and (c in _START or c in words or c in soft) and not (out[-1] in ")>" and c == "{") and (c not in "[*" or out[-1] == "}"):
                append("n")
        append(c)
        if c == "tpl":
            out += parts
    return out


_EMBEDDED = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|[{}]", re.S)

# ---------------------------------------------------------------- Go
_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_GO_BIN = "+ - * / % & | ^ << >> &^ && || == != < <= > >=".split()
_GO_ASSIGN = "= := += -= *= /= %= &= |= ^= <<= >>= &^=".split()


def _go() -> Grammar:
    def expressions(x: str, literal: str) -> str:
        return f"""
expr{x}: unary{x} (bin unary{x})*
unary{x}: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* prim{x}
prim{x}: oper{x} (post{literal and " | LIT"})*
oper{x}: 'num' | 'str' | 'rune' | 'func' sig FBLOCK | 'struct' STRUCT{" LIT" if literal else ""} | 'map' INDEX type LIT? | 'chan' type | 'interface' IFACE | INDEX type LIT? | 'id' | PAREN
exprs{x}: expr{x} (',' expr{x})*
simple{x}: exprs{x} (assign 'range'? exprs{x} | '++' | '--' | '<-' expr{x})?
"""
    return Grammar(
        f"""
start: ';'* (PACKAGES | 'package' 'id' semi) (IMPORTS1 | import semi)* (TOPS | top semi)*
semi: ';'+ | $
import: 'import' (('id' | '.')? 'str' | IMPORTS)
top: 'func' RECV? 'id' INDEX? sig FBLOCK? | declaration
declaration: 'var' (varspec | VARS) | 'const' (varspec | VARS) | 'type' (typespec | TYPES)
varspec: 'id' (',' 'id')* type? ('=' exprs)?
typespec: 'id' (!(INDEX type semi) INDEX)? '='? type
sig: PARAMS result?
result: PARAMS | type
type: 'id' ('.' 'id')? INDEX? | '*' type | INDEX type | 'map' INDEX type | '<-'? 'chan' '<-'? type | 'func' sig | 'struct' STRUCT | 'interface' IFACE | TPAREN
bin: {_any(_GO_BIN)}
assign: {_any(_GO_ASSIGN)}
post: '.' ('id' | ASSERT) | INDEX | ARGS
{expressions("", "y")}{expressions("N", "")}
stmt: declaration | 'return' exprs? | 'break' 'id'? | 'continue' 'id'? | 'goto' 'id' | 'fallthrough' | 'go' expr | 'defer' expr | if | 'switch' (simpleN? ';')? (simpleN)? SWITCH | 'select' SELECT | for | FBLOCK | 'id' ':' stmt? | simple
if: 'if' (simpleN? ';')? exprN FBLOCK ('else' (if | FBLOCK))?
for: 'for' (simpleN? ';' exprN? ';' simpleN? FBLOCK | (exprsN (':=' | '='))? 'range' exprN FBLOCK | exprN? FBLOCK)
stmts: ';'* (stmt (';'+ | $))*
clause: ('case' (simple | types) | 'default') ':' stmts
types: type (',' type)*
param: 'id' (',' 'id')* '...'? type | '...'? type
lit: (expr | LIT) (':' (expr | LIT))?
field: 'id' (',' 'id')* type 'str'? | '*'? 'id' ('.' 'id')? INDEX? 'str'?
method: 'id' sig | '~'? type ('|' '~'? type)*
argument: expr '...'? | type
""",
        """
PAREN: ( expr | type
TPAREN: ( type
ARGS: ( (argument (',' argument)* ','?)?
PARAMS: ( (param (',' param)* ','?)?
RECV: ( 'id'? '*'? 'id' INDEX? ','?
ASSERT: ( type | 'type'
IMPORTS: ( ((('id' | '.')? 'str') (';' ('id' | '.')? 'str')* ';'?)?
VARS: ( (varspec (';' varspec)* ';'?)?
TYPES: ( (typespec (';' typespec)* ';'?)?
INDEX: [ (expr? ':' expr? (':' expr)? | '...' | (param | argument) (',' (param | argument | expr))* ','? | 'id' (',' 'id')* method)?
FBLOCK: { STMTS* stmts
LIT: { (lit (',' lit)* ','?)?
STRUCT: { FIELDS* (field (';' field)* ';'?)?
IFACE: { METHODS* (method (';' method)* ';'?)?
SWITCH: { ';'* ((CLAUSES | clause) STMTS* stmts)*
SELECT: { ';'* ((CLAUSES | clause) STMTS* stmts)*
""",
        """
STMTS: ';'* (stmt ';'+)+ | ';'+
CLAUSES: ';'* clause+
FIELDS: (field ';'+)+
METHODS: (method ';'+)+
PACKAGES: ';'* 'package' 'id' semi
IMPORTS1: ';'* import semi
TOPS: ';'* top semi
""",
    )


GO = _go()
_GO_LEX = re.compile(
    r"((?:[ \t\r]|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/)++)|((?:\n|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)++)|([^\W\d]\w*+)"
    r"|((?:0[xX][0-9a-fA-F_]++(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?\d++)?|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)i?(?!\w))"
    r"|(\"(?:[^\"\\\n]|\\[^\n])*+\"|`[^`]*+`)|('(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"]))')"
    r"|(<<=|>>=|&\^=|\.\.\.|:=|\+\+|--|&&|\|\||<-|<<|>>|&\^|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^<>=!()\[\]{},;.:~])|(.)",
    re.S,
)
_GO_ENDS = {"id", "num", "str", "rune", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def _lex_go(text: str) -> list[str]:
    out: list[str] = []
    words, ends = set(_GO_WORDS), _GO_ENDS
    last = ""
    for m in _GO_LEX.finditer(text):
        kind = m.lastindex
        if kind == 1:
            continue
        if kind == 2:
            if last in ends:
                out.append(";")
                last = ";"
            continue
        if kind == 3:
            c = m[3] if m[3] in words else "id"
        elif kind == 7:
            c = m[7]
        elif kind == 8:
            raise Bad(m[0])
        else:
            c = ("num", "str", "rune")[kind - 4]
        out.append(c)
        last = c
    if last in ends:
        out.append(";")
    # A semicolon may be left out before a closing bracket.
    return out


# ---------------------------------------------------------------- Rust
_RUST_WORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()
_RUST_BIN = "+ - * / % & | ^ << && || == != < <= >=".split()
_RUST_ASSIGN = "= += -= *= /= %= &= |= ^= <<=".split()


def _rust() -> Grammar:
    def expressions(x: str, literal: str) -> str:
        return f"""
expr{x}: 'return' (!$ !',' expr{x})? | 'break' 'life'? (!$ !',' expr{x})? | 'continue' 'life'? | closure{x} | range{x}
range{x}: or{x} (('..' | '..=') or{x}?)? | ('..' | '..=') or{x}?
or{x}: unary{x} (bin (closure{x} | unary{x}) | assign expr{x} | 'as' type)*
unary{x}: ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* (withblock post* | prim{x} post*)
prim{x}: lit | macro | path{literal and " STRUCTLIT"} | path | 'move' closure{x} | closure{x} | PAREN | ARRAY | '_'
closure{x}: 'static'? 'async'? 'move'? ('||' | '|' (param (',' param)* ','?)? '|') ('->' type BLOCK | expr{x})
"""

    return Grammar(
        f"""
start: inner* (ITEMS1 | item)*
lit: 'num' | 'str' | 'char' | 'true' | 'false'
bin: {_any(_RUST_BIN)} | '>' '>'? !'='
assign: {_any(_RUST_ASSIGN)} | '>' '>='
seg: 'id' | 'self' | 'Self' | 'super' | 'crate' | 'await'
path: '::'? (seg | qself) ('::' ('id' | 'self' | 'super' | generics))*
qself: '<' type ('as' type)? '>'
macro: path '!' ('mac' | 'macb')
attr: 'attr'
inner: 'inner'
vis: 'pub' VIS?
item: attr* (vis? (fn | struct | enum | union | trait | mod | use | const | typealias | impl | externs) | macro ';'? | 'id' '!' 'id' ('mac' | 'macb') ';'?) | inner
quals: ('const' &('fn' | 'async' | 'unsafe' | 'extern'))? 'async'? 'unsafe'? ('extern' 'str'?)?
fn: quals 'fn' ('id' | 'await') tparams? PARAMS ('->' type)? where? (BLOCK | ';')
struct: 'struct' 'id' tparams? (where? FIELDS | TUPLE where? ';' | where? ';')
union: 'union' 'id' tparams? where? FIELDS
enum: 'enum' 'id' tparams? where? VARIANTS
trait: 'unsafe'? 'trait' 'id' tparams? (':' bounds)? where? ITEMS
impl: 'unsafe'? 'impl' tparams? '!'? type ('for' type)? where? ITEMS
mod: 'unsafe'? 'mod' 'id' (ITEMS | ';')
use: 'use' usetree ';'
usetree: '::'? (seg '::')* (USES | '*' | seg ('as' ('id' | '_'))?)
const: ('const' ('id' | '_') | 'static' 'mut'? 'id') (':' type)? ('=' expr)? ';'
typealias: 'type' 'id' tparams? (':' bounds)? where? ('=' type)? where? ';'
externs: 'unsafe'? 'extern' ('crate' ('id' | 'self') ('as' 'id')? ';' | 'str'? ITEMS)
where: 'where' (wbound (',' wbound)* ','?)?
wbound: 'life' ':' bounds? | forlife? type ':' bounds?
forlife: 'for' tparams
bounds: bound ('+' bound)* '+'?
bound: '?'? forlife? path fnargs? generics? | 'life' | TPAREN
fnargs: TYPES ('->' type)?
generics: '<' (garg (',' garg)* ','?)? '>'
garg: 'life' | 'id' generics? (':' bounds | '=' type) | type | '-'? lit | BLOCK
tparams: '<' (tparam (',' tparam)* ','?)? '>'
tparam: attr* ('life' (':' bounds?)? | 'const' 'id' ':' type ('=' (lit | BLOCK | path))? | 'id' (':' bounds?)? ('=' type)?)
type: ('&' | '&&') 'life'? 'mut'? type1 | '*' ('const' | 'mut') type1 | ('dyn' | 'impl') bounds | type1
type1: ('&' | '&&') 'life'? 'mut'? type1 | '*' ('const' | 'mut') type1 | 'dyn' bound | 'impl' bound | '!' | '_' | forlife? quals 'fn' TYPES ('->' type)? | forlife? tpath | macro | TPAREN | TYPES | SLICE
tpath: '::'? (seg | qself) ((generics | fnargs) | '::' ('id' | generics | fnargs))*
pattern: '|'? pat ('|' pat)*
pat: ('&' | '&&') 'mut'? pat | 'ref'? 'mut'? 'id' !'::' !TUPLEPAT !FIELDPAT !'!' ('@' pat | !'..' !'..=') | '_' | '..' | macro | range1 | path (TUPLEPAT | FIELDPAT)? | TUPLEPAT | SLICEPAT
range1: bound1 (('..' | '..=' | '...') bound1?)? | ('..' | '..=') bound1
bound1: '-'? lit | path !TUPLEPAT !FIELDPAT !'!'
post: '?' | '.' ('id' ('::' generics)? ARGS? | 'num' | 'await') | ARGS | INDEX
{expressions("", "y")}{expressions("N", "")}
param: attr* pat (':' type)?
withblock: ('life' ':')? ('if' condition BLOCK ('else' (withif | BLOCK))? | 'match' exprN ARMS | 'while' condition BLOCK | 'loop' BLOCK | 'for' pattern 'in' exprN BLOCK | 'unsafe' BLOCK | 'async' 'move'? BLOCK | 'const' BLOCK | BLOCK)
withif: 'if' condition BLOCK ('else' (withif | BLOCK))?
condition: cond1 (('&&' | '||') cond1)*
cond1: 'let' pattern '=' scrut | exprN
scrut: unaryN (binL unaryN)*
binL: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '==' | '!=' | '<' | '<='
stmt: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' BLOCK)?)? ';' | item | attr* withblock (&('.' | '?') post+ (bin unary)* (';' | $) | !('.' | '?') ';'?) | attr* path '!' 'macb' !('.' | '?') ';'? | attr* expr (';' | $)
arm: attr* pattern ('if' condition)? '=>' (withblock &(arm | $) | withblock ',' | expr (',' | $))
fieldinit: attr* ('id' | 'num') (':' expr)?
field: attr* vis? 'id' ':' type
variant: attr* vis? 'id' (FIELDS | TUPLE)? ('=' expr)?
fieldpat: attr* ('..' | ('id' | 'num') ':' pattern | 'ref'? 'mut'? 'id')
uset: usetree
self: '&'? 'life'? 'mut'? 'self' (':' type)?
parameter: attr* (self | pattern ':' type | type | '...')
""",
        """
PAREN: ( (expr (',' expr)* ','?)?
ARGS: ( (expr (',' expr)* ','?)?
PARAMS: ( (parameter (',' parameter)* ','?)?
TYPES: ( (('id' | '_')? ':' type | 'id' ':' type | type) (',' ('id' ':' type | type))* ','? | $
TUPLE: ( (attr* vis? type (',' attr* vis? type)* ','?)?
TUPLEPAT: ( (pattern (',' pattern)* ','?)?
VIS: ( 'crate' | 'self' | 'super' | 'in' path
TPAREN: ( bounds | type
ARRAY: [ (expr (';' expr | (',' expr)* ','?))?
INDEX: [ expr
SLICE: [ type (';' expr)?
SLICEPAT: [ (pattern (',' pattern)* ','?)?
BLOCK: { inner* (STMTS | stmt)*
STRUCTLIT: { (fieldinit (',' fieldinit)* (',' ('..' expr?)?)? | '..' expr)?
FIELDS: { (field (',' field)* ','?)?
VARIANTS: { (variant (',' variant)* ','?)?
ITEMS: { inner* (ITEMS1 | item)*
ARMS: { inner* arm*
USES: { (uset (',' uset)* ','?)?
FIELDPAT: { (fieldpat (',' fieldpat)* ','?)?
""",
        """
STMTS: inner* stmt+
ITEMS1: inner* item+
""",
    )


_RUST_LEX = re.compile(
    r"((?:\s|//[^\n]*+)++)|(/\*)|(b?r(#*)\".*?\"\4|[bc]?\"(?:[^\"\\]|\\.)*+\")|(b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[nrt0\\'\"]))')|('[^\W\d]\w*+)(?!')"
    r"|((?:r#)?[^\W\d]\w*+)|((?:0x[0-9a-fA-F_]++|0o[0-7_]++|0b[01_]++|\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?(?:[eE][+-]?[\d_]++)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w))"
    r"|(<<=|\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>=|[-+*/%&|^<>=!()\[\]{},;.:#?@$~])|(.)",
    re.S,
)
_RUST_COMMENT = re.compile(r"/\*|\*/")
_RUST_SET = frozenset(_RUST_WORDS)


def _lex_rust(text: str) -> list[str]:
    """Token classes; the token trees of a macro call are one token, 'macb' in braces and 'mac' else, and attributes too."""
    out: list[str] = []
    at, n, match = 0, len(text), _RUST_LEX.match
    if text.startswith("#!") and not text.startswith("#!["):
        at = (text.find("\n") + n + 1) % (n + 1)
    stack: list[tuple[str, int | None]] = []
    while at < n:
        m = match(text, at)
        kind = m.lastindex
        at = m.end()
        if kind == 1:
            continue
        if kind == 2:
            level = 1
            while level:
                m = _RUST_COMMENT.search(text, at)
                if not m:
                    raise Bad("comment")
                level += 1 if m[0] == "/*" else -1
                at = m.end()
            continue
        if kind in (3, 4):
            c = "str"
        elif kind == 5:
            c = "char"
        elif kind == 6:
            c = "life"
        elif kind == 7:
            c = m[7]
            c = "_" if c == "_" else c if c in _RUST_SET else "id"
        elif kind == 8:
            c = "num"
        elif kind == 9:
            c = m[9]
            if c in OPENING:
                trees = None
                if len(out) > 1 and out[-1] == "!" and out[-2] in ("id", "self", "super", "crate"):
                    trees = len(out)
                elif len(out) > 2 and out[-1] == "id" and out[-2] == "!" and out[-3] == "id":
                    trees = len(out)
                elif c == "[" and out and (out[-1] == "#" or len(out) > 1 and out[-1] == "!" and out[-2] == "#"):
                    trees = len(out)
                stack.append((c, trees))
            elif c in OPENING.values():
                if not stack or OPENING[stack[-1][0]] != c:
                    raise Bad("nesting")
                c0, trees = stack.pop()
                if trees is not None:
                    del out[trees:]
                    if out[-1] == "#":
                        out[-1] = "attr"
                    elif len(out) > 1 and out[-1] == "!" and out[-2] == "#":
                        out[-2:] = ["inner"]
                    else:
                        out.append("macb" if c0 == "{" else "mac")
                    continue
        else:
            raise Bad(m[0])
        out.append(c)
    return out


OPENING = {"(": ")", "[": "]", "{": "}"}
RUST = _rust()
#: In TypeScript a closing angle bracket may end a type and with it a statement.
_TS_ENDS = frozenset([*_JS_ENDS, ">"])
_JS_SET, _JS_SOFT_SET, _TS_SOFT_SET = frozenset(_JS_WORDS), frozenset(_JS_SOFT), frozenset([*_JS_SOFT, *(w for w in _TS_SOFT if w != "enum")])


def _lex_json(text: str) -> list[str]:
    out = []
    end = len(text.rstrip(" \t\r\n"))
    at, match = 0, _JSON.match
    while at < end:
        m = match(text, at)
        at = m.end()
        kind = m.lastindex
        if kind == 5:
            raise Bad(m[5])
        out.append("str" if kind == 1 else "num" if kind == 2 else m[kind])
    return out


#: By ending of the file name: (language, grammar, lexer).
LANGUAGES = {
    "js": ("javascript", JS, lambda t: _lex_ecma(t, _JS_SET, _JS_SOFT_SET)),
    "mjs": ("javascript", JS, lambda t: _lex_ecma(t, _JS_SET, _JS_SOFT_SET)),
    "ts": ("typescript", TS, lambda t: _lex_ecma(t, _JS_SET, _TS_SOFT_SET, 0, _TS_ENDS)),
    "mts": ("typescript", TS, lambda t: _lex_ecma(t, _JS_SET, _TS_SOFT_SET, 0, _TS_ENDS)),
    "go": ("go", GO, _lex_go),
    "rs": ("rust", RUST, _lex_rust),
    "json": ("json", JSON, _lex_json),
}
