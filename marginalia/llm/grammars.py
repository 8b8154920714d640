"""Grammars for the derivative parser, each narrower than or equal to its language.

Tokens in quotes are the token's own text; capitals are classes assigned by ``tokens``.
"""

from __future__ import annotations

from .derivative import Grammar

PYTHON = r"""
file = {stmt}
fragment = yieldexpr | starexprs
stmt = simple | compound | decorated | 'async' asyncable | asyncable
asyncable = funcdef | forstmt | withstmt
block = NEWLINE INDENT stmt {stmt} DEDENT | simple
simple = small smalltail
smalltail = ';' [small smalltail] NEWLINE | NEWLINE
smalltail = NEWLINE | ';' smallnext
smallnext = NEWLINE | small smalltail
small = starexprs | yieldexpr | assign | single AUG rhs | single ':' expr ['=' rhs] | 'del' dellist | 'pass' | 'break' | 'continue' | 'return' [starexprs] | 'raise' [expr ['from' expr]] | 'global' names | 'nonlocal' names | 'assert' expr [',' expr] | imports | 'type' n [typeparams] '=' expr
rhs = starexprs | yieldexpr
assign = targets '=' assigntail
assigntail = rhs | assign
names = n {',' n}
imports = 'import' dottedas {',' dottedas} | 'from' source 'import' ( '*' | '(' importlist ')' | importas {',' importas} )
source = dotted | dot {dot} [dotted]
dot = '.' | '...'
dotted = n {'.' n}
dottedas = dotted ['as' n]
importas = n ['as' n]
importlist = importas [',' [importlist]]
targets = starget [',' [targets]]
starget = '*' targ | targ
targ = n ta | n tb | literal tb | bracketed tb | '(' [targets] ')' | '[' [targets] ']'
single = n ta | n tb | literal tb | bracketed tb
ta = [tail]
tail = '.' n ta | '[' slices ']' ta | '(' args ')' tb
tb = tail
tail = '.' n ta | '[' slices ']' ta | '(' args ')' tb
dellist = deltarget [',' [dellist]]
deltarget = n ta | literal tb | bracketed tb | '(' [dellist] ')' | '[' [dellist] ']'
compound = ifstmt | whilestmt | trystmt | classdef | matchstmt
decorated = '@' named NEWLINE afterdecorator
afterdecorator = decorated | classdef | ['async'] funcdef
ifstmt = 'if' named ':' block {'elif' named ':' block} [elseblock]
elseblock = 'else' ':' block
whilestmt = 'while' named ':' block [elseblock]
forstmt = 'for' targets 'in' starexprs ':' block [elseblock]
withstmt = 'with' withitem {',' withitem} ':' block | 'with' '(' withlist ')' ':' block
withitem = expr ['as' starget]
withlist = withitem [',' [withlist]]
trystmt = 'try' ':' block handlers
handlers = finallyblock | except {except} [elseblock] [finallyblock] | exceptstar {exceptstar} [elseblock] [finallyblock]
finallyblock = 'finally' ':' block
except = 'except' [expr ['as' n]] ':' block
exceptstar = 'except' '*' expr ['as' n] ':' block
funcdef = 'def' n [typeparams] '(' [params] ')' ['->' expr] ':' block
classdef = 'class' n [typeparams] ['(' args ')'] ':' block
typeparams = '[' typeparam {',' typeparam} [','] ']'
typeparam = n [':' expr] ['=' expr] | '*' n | '**' n
params = pos0 | star | dstar
pos0 = param after0 | param '=' expr after1
after0 = [',' next0]
next0 = [pos0 | star | dstar | '/' afterslash]
after1 = [',' next1]
next1 = [param '=' expr after1 | star | dstar | '/' [',' [param '=' expr afterd | star | dstar]]]
afterslash = [',' [posd | star | dstar]]
posd = param afterslash | param '=' expr afterd
afterd = [',' [param '=' expr afterd | star | dstar]]
star = '*' param [',' [kwonly | dstar]] | '*' ',' kwonly
kwonly = param ['=' expr] [',' [kwonly | dstar]]
dstar = '**' param [',']
param = n [':' expr]
lparams = lpos0 | lstar | ldstar
lpos0 = n [',' [lpos0 | lstar | ldstar]] | n '=' expr lafterd
lafterd = [',' [n '=' expr lafterd | lstar | ldstar]]
lstar = '*' n [',' [lkwonly | ldstar]] | '*' ',' lkwonly
lkwonly = n ['=' expr] [',' [lkwonly | ldstar]]
ldstar = '**' n [',']
matchstmt = 'match' subject ':' NEWLINE INDENT case {case} DEDENT
subject = named [',' [starnameds]] | '*' bitor ',' [starnameds]
case = 'case' patterns ['if' named] ':' block
patterns = pattern0 [',' [patterns]]
pattern0 = '*' n | pattern
pattern = closed {'|' closed} ['as' n]
closed = ['-'] NUM [sign NUM] | CONST | strings | n {'.' n} ['(' [patargs] ')'] | '(' [patterns] ')' | '[' [patterns] ']' | '{' [mapping] '}'
sign = '+' | '-'
patargs = patarg [',' [patargs]]
patarg = pattern | n '=' pattern
mapping = '**' n [','] | mapkey ':' pattern [',' [mapping]]
mapkey = ['-'] NUM [sign NUM] | CONST | strings | n '.' n {'.' n}
named = expr | n ':=' expr
expr = lambda | disj ['if' disj 'else' expr]
lambda = 'lambda' [lparams] ':' expr
starexprs = starexpr [',' [starexprs]]
starexpr = '*' bitor | expr
starnameds = starnamed [',' [starnameds]]
starnamed = '*' bitor | named
yieldexpr = 'yield' yieldrest
yieldrest = 'from' expr | [starexprs]
disj = conj {'or' conj}
conj = inv {'and' inv}
inv = 'not' inv | bitor {cmpop bitor}
cmpop = CMP | 'in' | 'not' 'in' | 'is' ['not']
bitor = unary {binop unary}
binop = BINOP | '|' | '+' | '-' | '*' | '/' | '@'
unary = '+' unary | '-' unary | '~' unary | ['await'] atom {trailer} ['**' unary]
atom = n | literal | bracketed
literal = NUM | CONST | '...' | strings
strings = STR {STR} | BSTR {BSTR}
trailer = '.' n | '(' args ')' | '[' slices ']'
bracketed = '(' [parenbody] ')' | '[' [listbody] ']' | '{' [bracebody] '}'
parenbody = yieldexpr | named pafter | '*' bitor ',' [starnameds]
pafter = comp | [',' [starnameds]]
listbody = named lafter | '*' bitor [',' [starnameds]]
lafter = comp | [',' [starnameds]]
bracebody = '**' bitor dictmore | expr exprafter | n ':=' expr setmore | '*' bitor setmore
exprafter = ':' expr dictafter | comp | setmore
dictafter = comp | dictmore
dictmore = [',' [dictitems]]
dictitems = dictitem [',' [dictitems]]
dictitem = '**' bitor | expr ':' expr
setmore = [',' [starnameds]]
comp = ['async'] 'for' targets 'in' disj {'if' disj} [comp]
args = [named argafter | '*' expr [',' [arglist]] | kwlist]
argafter = comp | [',' [arglist]]
arglist = named [',' [arglist]] | '*' expr [',' [arglist]] | kwlist
kwlist = n '=' expr [',' [kwlist0]] | '**' expr [',' [kwlast]]
kwlist0 = kwlist | '*' expr [',' [kwlist0]]
kwlast = n '=' expr [',' [kwlast]] | '**' expr [',' [kwlast]]
slices = slice [',' [slices]]
slice = '*' bitor | named [colonrest] | colonrest
colonrest = ':' [expr] [':' [expr]]
n = NAME | 'match' | 'case' | 'type' | '_'
"""

JAVASCRIPT = r"""
module = {item}
fragment = expr
item = importdecl | exportdecl | stmt
importdecl = 'import' importrest
importrest = STR [withclause] sc | importclause 'from' STR [withclause] sc
withclause = 'with' object
importclause = n [',' (ns | namedimports)] | ns | namedimports
ns = '*' 'as' n
namedimports = '{' [importspecs] '}'
importspecs = importspec [',' [importspecs]]
importspec = n | iname 'as' n | STR 'as' n
exportdecl = 'export' exportrest
exportrest = '*' ['as' exportname] 'from' STR [withclause] sc | '{' [exportspecs] '}' ['from' STR [withclause]] sc | varstmt | func | asyncfunc | class | 'default' exportdefault
exportdefault = anyfunc | 'async' anyfunc | anyclass | assignnb sc | object objrest sc
objrest = trailers assrest
exportspecs = exportspec [',' [exportspecs]]
exportspec = exportname ['as' exportname]
exportname = iname | STR
stmt = block | varstmt | ';' | assignnb {',' assign} sc | ifstmt | loops | 'continue' [n] sc | 'break' [n] sc | 'return' [expr] sc | 'throw' expr sc | n ':' stmt | switch | trystmt | 'debugger' sc | func | asyncfunc | class
sc = ';' | ASI
block = '{' {stmt} '}'
varstmt = ('var' | 'let' | 'const') binding {',' binding} sc
binding = n ['=' assign] | pattern '=' assign
pattern = '[' [arraypats] ']' | '{' [objpats] '}'
arraypats = ',' [arraypats] | patelem [',' [arraypats]] | '...' target
patelem = target ['=' assign]
target = n | pattern
objpats = '...' n | objpat [',' [objpats]]
objpat = n ['=' assign] | propname ':' patelem
ifstmt = 'if' '(' expr ')' stmt ['else' stmt]
loops = 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [sc] | 'for' ['await'] '(' forhead ')' stmt
forhead = fordecl | [expr] ';' [expr] ';' [expr] | lhs 'of' assign
fordecl = ('var' | 'let' | 'const') forbind
forbind = target ('of' assign | 'in' expr) | binding {',' binding} ';' [expr] ';' [expr]
switch = 'switch' '(' expr ')' '{' {clause} '}'
clause = ('case' expr | 'default') ':' {stmt}
trystmt = 'try' block ( 'catch' ['(' target ')'] block ['finally' block] | 'finally' block )
func = 'function' ['*'] n params block
anyfunc = 'function' ['*'] [n] params block
asyncfunc = 'async' func
params = '(' [paramlist] ')'
paramlist = '...' target | patelem [',' [paramlist]]
class = 'class' n classtail
anyclass = 'class' [n] classtail
classtail = ['extends' lhs] '{' {member} '}'
member = ';' | ['static'] method | ['static'] field sc | 'static' block
field = propname ['=' assign]
method = ['async'] ['*'] propname params block | ('get' | 'set') propname params block
propname = iname | STR | NUM | PRIV | '[' assign ']'
expr = assign {',' assign}
assign = prefixop unary condrest | lhs assrest | arrow | 'yield' [['*'] assign]
assignnb = prefixop unary condrest | lhsnb assrest | arrow | 'yield' [['*'] assign]
assrest = ASSIGN assign | '=' assign | [INCDEC] condrest
condrest = {binop unary} ['?' assign ':' assign]
binop = BINOP | '+' | '-' | '*' | '/' | 'in' | 'instanceof'
prefixop = '+' | '-' | '!' | '~' | INCDEC | 'typeof' | 'void' | 'delete' | 'await'
unary = prefixop unary | lhs [INCDEC]
lhs = primary trailers
lhsnb = primarynb trailers
trailers = {trailer}
trailer = '.' (iname | PRIV) | '?.' (iname | PRIV | args | '[' expr ']' | TPL) | args | '[' expr ']' | TPL
args = '(' [arglist] ')'
arglist = ['...'] assign [',' [arglist]]
primary = primarynb | object | anyfunc | 'async' anyfunc | anyclass
primarynb = n | NUM | STR | TPL | RE | CONST | 'this' | 'super' | '(' expr ')' | '[' [elements] ']' | 'new' newrest | 'import' (args | '.' iname) | PRIV 'in' unary
newrest = '.' iname | ['new'] primary {newtrailer} [args]
newtrailer = '.' (iname | PRIV) | '[' expr ']' | TPL
elements = ',' [elements] | ['...'] assign [',' [elements]]
object = '{' [props] '}'
props = prop [',' [props]]
prop = '...' assign | n ['=' assign] | propname ':' assign | method
arrow = arrowparams '=>' arrowbody | 'async' arrowparams '=>' arrowbody
arrowparams = n | params
arrowbody = block | assignnb
n = NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from'
iname = n | KEYWORD | CONST | 'this' | 'super' | 'import' | 'export' | 'default' | 'var' | 'let' | 'const' | 'if' | 'else' | 'while' | 'do' | 'for' | 'await' | 'continue' | 'break' | 'return' | 'throw' | 'switch' | 'case' | 'try' | 'catch' | 'finally' | 'debugger' | 'function' | 'class' | 'extends' | 'yield' | 'in' | 'instanceof' | 'typeof' | 'void' | 'delete' | 'new' | 'with'
"""

JSON = r"""
text = value
value = STR | NUM | CONST | '{' [members] '}' | '[' [values] ']'
members = STR ':' value {',' STR ':' value}
values = value {',' value}
"""

TOML = r"""
text = line {NEWLINE line}
line = [pair | '[' key ']' | '[[' key ']]']
pair = key '=' value
key = part {'.' part}
part = BARE | STR
value = STR | MSTR | NUM | BAREVAL | '[' breaks [values] ']' | '{' [pairs] '}'
values = value breaks [',' breaks [values]]
pairs = pair {',' pair}
breaks = {NEWLINE}
"""

GRAMMARS = {
    "py": (Grammar(PYTHON), "file"),
    "js": (Grammar(JAVASCRIPT), "module"),
    "json": (Grammar(JSON), "text"),
    "toml": (Grammar(TOML), "text"),
}
