"""Grammars of the code languages for ``chart``: kinds of tokens and rules over them.

Names are taken on trust: a name in capitals or with two underscores may be a macro, so it may stand where an attribute, a
statement or a loop head does. What only a compiler's later stages refuse (types, unknown names, misplaced ``return``)
isn't the concern of these rules.
"""

from __future__ import annotations

# The reserved words and operators of the languages, by their part in the rules. ---------------------------
C_CLASSES = {
    "BASE": "void char short int long float double signed unsigned _Bool bool _Complex",
    "QUAL": "const volatile static extern inline register restrict typedef _Noreturn _Thread_local _Atomic constexpr thread_local "
    "__restrict __inline __const __volatile__ __inline__ __extension__",
    "CONST": "true false nullptr",
    "ASSIGN": "+= -= *= /= %= &= |= ^= <<= >>=",
    "PREFIX": "! ~",
    "PM": "+ -",
    "STEP": "++ --",
    "OP": "/ % << <= >= == != | || ^",
}
C_WORDS = (
    "struct union enum if while switch for do else return break continue goto case default sizeof alignof _Alignof _Alignas alignas typeof "
    "__typeof__ __attribute__ __declspec __asm__ asm _Static_assert static_assert = * & && < > . -> ... ; , : ?"
)
CPP_CLASSES = C_CLASSES | {
    "BASE": C_CLASSES["BASE"] + " wchar_t char8_t char16_t char32_t",
    "QUAL": C_CLASSES["QUAL"] + " virtual explicit friend mutable consteval constinit",
    "CONST": C_CLASSES["CONST"] + " this",
    "CAST": "static_cast dynamic_cast const_cast reinterpret_cast",
    "ACCESS": "public private protected",
    "OP": C_CLASSES["OP"] + " <=>",
    "ENDS": "override final",
}
CPP_WORDS = C_WORDS + (
    " class auto namespace using template typename new delete throw co_await co_yield co_return operator try catch noexcept decltype typeid concept requires "
    ":: ->* .* ~ !"
)
JS_CLASSES = {
    "ASSIGN": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=",
    "NOT": "! ~",
    "PREFIX": "typeof void delete",
    "PM": "+ -",
    "STEP": "++ --",
    "OP": "/ % ** << >> >>> < > <= >= == != === !== & | && || ^ ??",
    "CONST": "null true false this super",
    "SOFT": "get set from as target meta",
}
JS_WORDS = (
    "var let const function if while switch with for do else return throw break continue debugger case default try catch finally class extends new "
    "instanceof await yield in of import export async static = * => . ?. ... ; , : ?"
)
PY_CLASSES = {
    "AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
    "PM": "+ -",
    "MUL": "// % << >> & ^",
    "COMP": "< > == != <= >=",
    "CONST": "None True False",
}
PY_WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield match case type = := : , . -> ; ... * ** / @ | ~"
)

C_RULES = """
name = NAME | MACRO
attribute = '__attribute__' '(ARGS)' | '__declspec' '(ARGS)' | MACRO '(MACROARGS)'? | '[LIST]' | '_Alignas' '(ARGS)' | 'alignas' '(ARGS)'
strings = STRING (name? STRING)* name? | name STRING (name? STRING)*
primary = name | NUMBER | CONST | strings | '(EXPR)' | '(STATEMENT)'
postfix = primary ('(ARGS)' | '[EXPR]' | '.' name | '->' name | STEP)* | '(TYPENAME)' '{INIT}' ('.' name | '[EXPR]' | '->' name)*
prefix = PM | PREFIX | STEP | '*' | '&' | '&&' | '(TYPENAME)' | 'sizeof' | 'alignof' | '_Alignof'
unary = prefix* (postfix | ('sizeof' | 'alignof' | '_Alignof') '(TYPENAME)')
infix = OP | PM | '*' | '&' | '&&' | '<' | '>' | '>' '>'
binary = unary (infix unary)*
ternary = binary ('?' EXPR? ':' binary)*
assigned = ASSIGN | '='
TERNARY = ternary
ASG = ternary (assigned ternary)*
EXPR = ASG (',' ASG)*
STATEMENT = '{BLOCK}'
specified = 'struct' attribute* name? '{MEMBERS}' attribute* | 'union' attribute* name? '{MEMBERS}' attribute* | 'enum' attribute* name? '{ENUM}' | ('struct' | 'union' | 'enum') attribute* name | ('typeof' | '__typeof__') ('(ARGS)' | '(TYPENAME)') | MACRO '(MACROARGS)'
SPECS = (QUAL | attribute)* (BASE (BASE | QUAL | attribute)* | (name | specified) (QUAL | attribute)*)
pointer = '*' (QUAL | attribute)*
suffix = '(PARAMS)' | '[INDEX]'
declared = pointer* attribute* (name | '(DECLARED)') suffix* attribute* ('__asm__' '(ARGS)' | 'asm' '(ARGS)')?
DECLARED = attribute* QUAL? declared
abstract = pointer+ ('(ABSTRACT)')? suffix* | '(ABSTRACT)' suffix* | suffix+
ABSTRACT = attribute* QUAL? abstract
TYPENAME = SPECS abstract?
PARAM = SPECS (declared | abstract)?
PARAMS = (PARAM (',' PARAM)* (',' '...')? | '...')?
INDEX = (QUAL* EXPR | QUAL* '*' | QUAL+)?
ARG = ASG | TYPENAME | '{INIT}'
ARGS = (ARG (',' ARG)*)?
MACROARG = ASG | TYPENAME | '{INIT}' | '(PARAMS)' | '{BLOCK}' | 'default'
MACROARGS = (MACROARG? (',' MACROARG?)*)?
LIST = '[ARGS]'
designator = ('.' name | '[RANGE]')+ '='? | name ':'
RANGE = ternary ('...' ternary)?
ITEM = designator? (ASG | '{INIT}')
INIT = (ITEM (',' ITEM)* ','?)?
ENTRY = name attribute* ('=' ternary)?
ENUM = (ENTRY (',' ENTRY)* ','?)?
value = '=' (ASG | '{INIT}')
DECL = SPECS (declared value? (',' declared value?)*)? ';'
field = declared (':' ternary)? | ':' ternary
MEMBER = SPECS (field (',' field)*)? ';' | ';' | MACRO '(MACROARGS)'? | ('_Static_assert' | 'static_assert') '(ARGS)' ';'
MEMBERS = MEMBER*
MEMBERELEMENTS = MEMBER+
FOR = (SPECS declared value? (',' declared value?)* | EXPR)? ';' EXPR? ';' EXPR?
assembly = ('asm' | '__asm__') (QUAL | 'goto')* ('(ASM)' | '(ARGS)') ';'
OPERAND = STRING ('(EXPR)')? | '[EXPR]' STRING '(EXPR)' | name
ASM = strings (':' (OPERAND (',' OPERAND)*)?)*
LABEL = name ':' | 'case' TERNARY ('...' TERNARY)? ':' | 'default' ':'
controlled = 'if' '(EXPR)' STMT ('else' STMT)? | 'while' '(EXPR)' STMT | 'for' '(FOR)' STMT | 'switch' '(EXPR)' STMT | 'do' STMT 'while' '(EXPR)' ';' | name '(ARGS)' '{BLOCK}'
jump = 'return' (EXPR | '{INIT}')? ';' | 'break' ';' | 'continue' ';' | 'goto' '*'? name ';'
STMT = ';' | EXPR ';' | DECL | '{BLOCK}' | controlled | jump | assembly | LABEL STMT? | ('_Static_assert' | 'static_assert') '(ARGS)' ';'
BLOCK = STMT*
STMTELEMENTS = STMT+
FUNCTION = SPECS? pointer* (name | '(DECLARED)') '(PARAMS)' attribute* DECL* '{BLOCK}'
TOP = ';' | DECL | FUNCTION | assembly | MACRO '(MACROARGS)'? | QUAL STRING ('{TOPS}' | DECL | FUNCTION) | ('_Static_assert' | 'static_assert') '(ARGS)' ';'
TOPS = TOP*
TOPELEMENTS = TOP+
"""

CPP_RULES = """
ident = NAME | MACRO | ENDS
template = '<' (TARG '...'? (',' TARG '...'?)*)? '>'
OPNAME = 'operator' (OP | PM | PREFIX | STEP | ASSIGN | '=' | '*' | '&' | '&&' | '<' | '>' | '>' '>' | '->' | '->*' | ',' | '(NONE)' | '[NONE]' | ('new' | 'delete') '[NONE]'? | STRING NAME? | 'co_await' | TYPENAME)
NONE = BASE?
QNAME = '::'? (ident template? '::' 'template'?)* (ident template? | '~' ident | OPNAME)
attribute = '__attribute__' '(ARGS)' | '__declspec' '(ARGS)' | MACRO '(MACROARGS)'? | '[LIST]' | 'alignas' ('(ARGS)' | '(TYPENAME)')
strings = STRING (ident? STRING)* ident? | ident STRING (ident? STRING)*
lambda = '[CAPTURE]' ('<' TPARAMS '>')? ('(PARAMS)' after*)? '{BLOCK}'
CAPTURE = (captured (',' captured)*)?
captured = '&' | '=' | '&'? '...'? ident ('=' ASG | '{INIT}')? '...'? | '*'? CONST
fresh = 'new' '(ARGS)'? (SPECS ptr* '[INDEX]'* | '(TYPENAME)') ('(ARGS)' | '{INIT}')?
primary = QNAME | NUMBER ident? | CONST | strings | '(EXPR)' | '(STATEMENT)' | '(FOLD)' | BASE+ ('(ARGS)' | '{INIT}') | QNAME '{INIT}' | 'typename' QNAME ('(ARGS)' | '{INIT}') | CAST '<' TYPENAME '>' '(ARGS)' | lambda | fresh | 'decltype' '(ARGS)' ('::' QNAME | '{INIT}' | '(ARGS)') | ('typeid' | 'noexcept' | 'sizeof' '...' | 'alignof' | 'sizeof') ('(ARGS)' | '(TYPENAME)') | 'requires' '(PARAMS)'? '{REQUIREMENTS}'
FOLD = unary (infix | assigned | ',') '...' ((infix | assigned | ',') unary)? | '...' (infix | assigned | ',') unary
REQUIREMENTS = (EXPR ';' | '{STATEMENTEXPR}' 'noexcept'? ('->' TYPENAME)? ';' | 'typename' QNAME ';' | 'requires' EXPR ';')+
STATEMENTEXPR = EXPR
member = '.' | '->' | '.*' | '->*'
postfix = primary ('(ARGS)' | '[EXPR]' | '[INIT]' | member 'template'? QNAME | STEP | '{INIT}' )*
prefix = PM | PREFIX | '!' | '~' | STEP | '*' | '&' | '&&' | '(TYPENAME)' | 'sizeof' | 'co_await' | '::'? 'delete' '[NONE]'?
unary = prefix* (postfix | '(TYPENAME)' '{INIT}')
infix = OP | PM | '*' | '&' | '&&' | '<' | '>' | '>' '>'
near = OP | PM | '*' | '&' | '&&'
binary = unary (infix unary)*
ternary = binary ('?' EXPR ':' (binary | 'throw' ASG))*
assigned = ASSIGN | '='
TERNARY = ternary
ASG = ternary (assigned (ternary | '{INIT}'))* | 'throw' ASG? | 'co_yield' (ASG | '{INIT}')
EXPR = ASG '...'? (',' ASG '...'?)*
STATEMENT = '{BLOCK}'
TARG = TYPENAME | unary (near unary)*
base = (ACCESS | QUAL)* QNAME '...'?
kind = 'class' | 'struct' | 'union'
specified = kind attribute* QNAME? ENDS? (':' base (',' base)*)? '{MEMBERS}' | 'enum' kind? attribute* QNAME? (':' TYPENAME)? '{ENUM}' | (kind | 'enum' kind?) attribute* QNAME | 'typename' QNAME | 'decltype' '(ARGS)' | QNAME? 'auto' | ('typeof' | '__typeof__') ('(ARGS)' | '(TYPENAME)') | '::'? QNAME | MACRO '(MACROARGS)'
SPECS = (QUAL | attribute)* (BASE (BASE | QUAL | attribute)* | specified (QUAL | attribute)*)
ptr = ('*' | '&' | '&&' | QNAME '::' '*') (QUAL | attribute)*
after = QUAL | '&' | '&&' | ENDS | 'noexcept' ('(ARGS)')? | '->' TYPENAME | attribute | 'requires' TERNARY | 'throw' '(ARGS)'
suffix = '(PARAMS)' after* | '[INDEX]'
declared = ptr* attribute* '...'? (QNAME | '(DECLARED)' | '[NAMES]') suffix* attribute*
NAMES = NAME (',' NAME)*
DECLARED = attribute* QUAL? (QNAME '::')? declared
abstract = ptr+ '...'? ('(ABSTRACT)')? suffix* | '...' | '(ABSTRACT)' suffix* | suffix+
ABSTRACT = attribute* QUAL? (QNAME '::')? abstract
TYPENAME = SPECS abstract?
PARAM = SPECS (declared | abstract)? ('=' (ASG | '{INIT}'))?
PARAMS = (PARAM (',' PARAM)* (','? '...')? | '...')?
INDEX = (EXPR | QUAL* '*')?
ARG = (ASG | '{INIT}') '...'? | TYPENAME
ARGS = (ARG (',' ARG)*)?
MACROARG = ASG | TYPENAME | '{INIT}' | '(PARAMS)' | '{BLOCK}' | 'default'
MACROARGS = (MACROARG? (',' MACROARG?)*)?
LIST = '[ATTRS]'
ATTRS = (ATTR (',' ATTR)*)?
ATTR = 'using' ident ':' QNAME | (QNAME | QUAL | 'noexcept') ('(ARGS)')?
ITEM = (('.' ident | '[EXPR]')+ '='?)? (ASG '...'? | '{INIT}')
INIT = (ITEM (',' ITEM)* ','?)?
ENTRY = ident attribute* ('=' ternary)?
ENUM = (ENTRY (',' ENTRY)* ','?)?
value = '=' (ASG | '{INIT}') | '{INIT}' | '(ARGS)'
DECL = SPECS (declared value? (',' declared value?)*)? ';'
pure = '=' (NUMBER | 'default' | 'delete' ('(ARGS)')?)
started = QNAME ('(ARGS)' | '{INIT}') '...'?
constructed = ':' started (',' started)*
handler = 'catch' ('(PARAM)' | '(REST)') '{BLOCK}'
REST = '...'
routine = ptr* attribute* (QNAME | '(DECLARED)') '(PARAMS)' after*
FUNCTION = (QUAL | attribute)* SPECS? routine (constructed? '{BLOCK}' | 'try' constructed? '{BLOCK}' handler+ | pure ';') | (QUAL | attribute)* routine ';'
using = 'using' 'namespace' attribute* QNAME ';' | 'using' 'enum' QNAME ';' | 'using' 'typename'? QNAME (',' QNAME)* ';' | 'using' ident attribute* '=' TYPENAME ';'
TPARAM = SPECS (declared | abstract)? ('=' TARG)? | ('template' '<' TPARAMS '>')? ('typename' | 'class') '...'? NAME? ('=' TYPENAME)?
TPARAMS = TPARAM (',' TPARAM)*
generic = 'template' '<' '>' | 'template' '<' TPARAMS '>' ('requires' TERNARY)? | 'template'
stated = 'static_assert' '(ARGS)' ';' | '_Static_assert' '(ARGS)' ';'
field = declared (':' ternary)? value? | ':' ternary
MEMBER = SPECS (field (',' field)*)? ';' | ';' | ACCESS ident? ':' | FUNCTION | using | stated | generic MEMBER | MACRO '(MACROARGS)'? | 'concept' ident '=' EXPR ';'
MEMBERS = MEMBER*
MEMBERELEMENTS = MEMBER+
FOR = FORINIT? ';' EXPR? ';' EXPR? | (FORINIT ';')? SPECS declared ':' (EXPR | '{INIT}')
FORINIT = SPECS declared value? (',' declared value?)* | EXPR | using
CONDITION = ((FORINIT? ';')? (EXPR | SPECS declared ('=' (ASG | '{INIT}') | '{INIT}')))
assembly = ('asm' | '__asm__') (QUAL | 'goto')* ('(ASM)' | '(ARGS)') ';'
OPERAND = STRING ('(EXPR)')? | '[EXPR]' STRING '(EXPR)' | ident
ASM = strings ((':' | '::') (OPERAND (',' OPERAND)*)?)*
LABEL = ident ':' | 'case' TERNARY ('...' TERNARY)? ':' | 'default' ':'
controlled = 'if' QUAL? '(CONDITION)' STMT ('else' STMT)? | 'if' '!'? QUAL '{BLOCK}' ('else' STMT)? | 'while' '(CONDITION)' STMT | 'for' '(FOR)' STMT | 'switch' '(CONDITION)' STMT | 'do' STMT 'while' '(EXPR)' ';' | ident '(ARGS)' '{BLOCK}' | 'try' '{BLOCK}' handler+
jump = ('return' | 'co_return') (EXPR | '{INIT}')? ';' | 'break' ';' | 'continue' ';' | 'goto' '*'? ident ';'
STMT = attribute* (';' | EXPR ';' | DECL | '{BLOCK}' | controlled | jump) | assembly | LABEL STMT? | using | stated
BLOCK = STMT*
STMTELEMENTS = STMT+
TOP = ';' | DECL | FUNCTION | assembly | MACRO '(MACROARGS)'? | QUAL STRING ('{TOPS}' | DECL | FUNCTION) | QUAL? 'namespace' attribute* QNAME? attribute* '{TOPS}' | 'namespace' ident '=' QNAME ';' | using | stated | QUAL? generic TOP | 'concept' ident '=' EXPR ';'
TOPS = TOP*
TOPELEMENTS = TOP+
"""

JS_RULES = """
name = NAME | SOFT | 'async' | 'static' | 'of' | 'let' | 'await' | 'yield'
word = NAME | SOFT | CONST | PREFIX | 'instanceof' | 'async' | 'static' | 'of' | 'let' | 'await' | 'yield' | 'var' | 'const' | 'function' | 'if' | 'while' | 'switch' | 'with' | 'for' | 'do' | 'else' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'case' | 'default' | 'try' | 'catch' | 'finally' | 'class' | 'extends' | 'new' | 'in' | 'import' | 'export'
end = ';' | END
key = word | STRING | NUMBER | PRIVATE | '[ASG]'
function = 'async'? 'function' '*'? name? '(PARAMS)' '{BLOCK}'
KLASS = 'class' name? ('extends' left)? '{CLASS}'
simple = name | NUMBER | STRING | REGEX | CONST | '(EXPR)' | '[ARRAY]' | '{OBJECT}' | '`' | function | KLASS | 'import' '(ARGS)' | 'import' '.' SOFT | 'new' '.' SOFT
trailer = ('.' | '?.') (word | PRIVATE) | '?.'? '(ARGS)' | '?.'? '[EXPR]' | '`'
left = 'new'* simple trailer*
target = name | '(EXPR)' | '[ARRAY]' | '{OBJECT}' | 'new'* simple trailer* (('.' | '?.') (word | PRIVATE) | '?.'? '[EXPR]')
prefix = PM | NOT | PREFIX | STEP | 'await'
unary = prefix* left STEP?
infix = OP | PM | '*' | 'in' | 'instanceof'
BINARY = (PRIVATE 'in')? unary (infix unary)*
arrow = 'async'? (name | '(PARAMS)') '=>' (ASG | '{BLOCK}')
ASG = arrow | target (ASSIGN | '=') ASG | BINARY ('?' ASG ':' ASG)? | 'yield' '*'? ASG
EXPR = ASG (',' ASG)*
plain = name | NUMBER | STRING | REGEX | CONST | '(EXPR)' | '[ARRAY]' | '`' | 'import' '(ARGS)' | 'import' '.' SOFT | 'new' '.' SOFT
opening = 'new'+ simple trailer* | plain trailer*
opened = prefix+ left STEP? | opening STEP?
first = name | '(EXPR)' | '[ARRAY]' | ('new'+ simple | plain) trailer* (('.' | '?.') (word | PRIVATE) | '?.'? '[EXPR]')
STARTED = (PRIVATE 'in')? opened (infix unary)*
FIRST = arrow | first (ASSIGN | '=') ASG | STARTED ('?' ASG ':' ASG)? | 'yield' '*'? ASG
ARG = '...'? ASG
ARGS = (ARG (',' ARG)* ','?)?
ARRAY = ','* (ARG (','+ ARG)* ','*)?
method = ('async'? '*'? | SOFT) key '(PARAMS)' '{BLOCK}'
PROPERTY = name ('=' ASG)? | key ':' ASG | '...' ASG | method
OBJECT = (PROPERTY (',' PROPERTY)* ','?)?
MEMBER = ';' | END | 'static'? (method | key ('=' ASG)? end) | 'static' '{BLOCK}'
CLASS = MEMBER*
MEMBERELEMENTS = MEMBER* END?
bound = name | '[BOUNDLIST]' | '{BOUNDS}'
BOUND = bound ('=' ASG)?
BOUNDLIST = ','* (('...'? BOUND) (','+ '...'? BOUND)* ','*)?
BOUNDS = (BOUNDPART (',' BOUNDPART)* ','?)?
BOUNDPART = name ('=' ASG)? | key ':' BOUND | '...' bound
PARAMS = ('...'? BOUND (',' '...'? BOUND)* ','?)?
given = bound '=' ASG
loose = name ('=' ASG)? | given
VAR = ('var' | 'let') loose (',' loose)* | 'const' given (',' given)*
FOR = (VAR | EXPR)? ';' EXPR? ';' EXPR? | ('var' | 'let' | 'const') bound ('of' ASG | 'in' EXPR) | target ('of' ASG | 'in' EXPR)
CATCH = BOUND
MODULES = (part (',' part)* ','?)?
part = (word | STRING) (SOFT (word | STRING))?
source = SOFT STRING (('with' | NAME) '{OBJECT}')?
import = 'import' STRING end | 'import' (name (',' ('{MODULES}' | '*' SOFT name))? | '{MODULES}' | '*' SOFT name) source end
export = 'export' (VAR end | function | KLASS | 'default' (function | KLASS | ASG end) | '{MODULES}' source? end | '*' (SOFT word)? source end)
STMT = ';' | END | '{BLOCK}' | VAR end | FIRST (',' ASG)* end | function | KLASS | 'if' '(EXPR)' STMT ('else' STMT)? | 'for' 'await'? '(FOR)' STMT | 'while' '(EXPR)' STMT | 'do' STMT ';'? 'while' '(EXPR)' end? | ('break' | 'continue') name? end | 'return' EXPR? end | 'throw' EXPR end | 'with' '(EXPR)' STMT | 'switch' '(EXPR)' '{CASES}' | name ':' STMT | 'try' '{BLOCK}' (catch finally? | finally) | 'debugger' end | import | export
catch = 'catch' ('(CATCH)')? '{BLOCK}'
finally = 'finally' '{BLOCK}'
BLOCK = STMT*
STMTELEMENTS = STMT* END?
CASE = 'case' EXPR ':' | 'default' ':' | STMT
CASES = CASE*
CASEELEMENTS = CASE* END?
"""

JSON_RULES = """
value = STRING | NUMBER | CONST | '[LIST]' | '{OBJECT}'
LIST = (value (',' value)*)?
OBJECT = (STRING ':' value (',' STRING ':' value)*)?
FILE = value
"""

PY_RULES = """
name = NAME | 'match' | 'case' | 'type'
strings = STRING+ | BYTES+
atom = name | NUMBER | strings | CONST | '...' | '(PAREN)' | '[LIST]' | '{DICT}'
trailer = '.' name | '(ARGS)' | '[SLICES]'
primary = atom trailer*
infix = PM | MUL | '*' | '**' | '/' | '@' | '|'
unary = (PM | '~')* 'await'? primary
sum = unary (infix unary)*
against = COMP | 'in' | 'not' 'in' | 'is' 'not'?
comparison = sum (against sum)*
negation = 'not'* comparison
disjunction = negation (('and' | 'or') negation)*
EXPR = disjunction ('if' disjunction 'else' EXPR)? | 'lambda' LPARAMS? ':' EXPR
SUM = sum
CHOICE = disjunction
NAMED = (name ':=')? EXPR
STAR = EXPR | '*' SUM
NSTAR = NAMED | '*' SUM
exprs = STAR (',' STAR)* ','?
nexprs = NSTAR (',' NSTAR)* ','?
YIELD = 'yield' (exprs | 'from' EXPR)?
clause = 'async'? 'for' targets 'in' CHOICE ('if' CHOICE)*
PAREN = (YIELD | NAMED clause* | NSTAR ',' nexprs?)?
LIST = (nexprs | NAMED clause+)?
DICT = (pair (',' pair)* ','? | EXPR ':' EXPR clause+ | nexprs | NAMED clause+)?
pair = EXPR ':' EXPR | '**' SUM
SLICE = EXPR? ':' EXPR? (':' EXPR?)? | NSTAR
SLICES = SLICE (',' SLICE)* ','?
plain = NAMED | '*' EXPR
named = name '=' EXPR
listed = plain (',' plain)* (',' later)? | later
later = (named | '**' EXPR) (',' (named | '**' EXPR | '*' EXPR))*
ARGS = (listed ','? | NAMED clause+)?
aimed = primary ('.' name | '[SLICES]')
TARGET = name | aimed | '(TARGETS)' | '[TARGETS]'
target = '*'? TARGET
targets = target (',' target)* ','?
TARGETS = targets?
single = name | aimed | '(SINGLE)'
SINGLE = single
DELETED = name | aimed | '(DELETEDS)' | '[DELETEDS]'
DELETEDS = (DELETED (',' DELETED)* ','?)?
P = name (':' EXPR)?
PD = name (':' EXPR)? '=' EXPR
placed = P (',' P)* (',' PD)* | PD (',' PD)*
only = ',' '/'
positional = placed (only (',' PD)*)? | P (',' P)* only (',' P)* (',' PD)*
keywords = '*' name (':' STAR)? (',' (P | PD))* (',' '**' P)? | '*' (',' (P | PD))+ (',' '**' P)? | '**' P
PARAMS = ((positional (',' keywords)? | keywords) ','?)?
L = name
LD = name '=' EXPR
lplaced = L (',' L)* (',' LD)* | LD (',' LD)*
lpositional = lplaced (only (',' LD)*)? | L (',' L)* only (',' L)* (',' LD)*
lkeywords = '*' name (',' (L | LD))* (',' '**' L)? | '*' (',' (L | LD))+ (',' '**' L)? | '**' L
LPARAMS = (lpositional (',' lkeywords)? | lkeywords) ','?
tparam = name (':' EXPR)? ('=' EXPR)? | '*' name ('=' STAR)? | '**' name ('=' EXPR)?
TPARAMS = tparam (',' tparam)* ','?
dotted = name ('.' name)*
aliased = name ('as' name)?
IMPORTS = aliased (',' aliased)* ','?
import = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | '(IMPORTS)' | aliased (',' aliased)*)
SMALL = exprs | YIELD | (targets '=')+ (exprs | YIELD) | single AUG (exprs | YIELD) | single ':' EXPR ('=' (exprs | YIELD))? | 'return' exprs? | 'raise' (EXPR ('from' EXPR)?)? | 'pass' | 'break' | 'continue' | 'del' DELETED (',' DELETED)* ','? | 'assert' EXPR (',' EXPR)? | ('global' | 'nonlocal') name (',' name)* | import | 'type' name ('[TPARAMS]')? '=' EXPR
SIMPLE = SMALL (';' SMALL)* ';'? NL
body = ':' (SIMPLE | NL '<BLOCK>')
else = 'else' body
ITEM = EXPR ('as' target)?
ITEMS = ITEM (',' ITEM)* ','?
decorated = ('@' NAMED NL)*
excepted = 'except' (EXPR ('as' name)?)? body
grouped = 'except' '*' EXPR ('as' name)? body
finally = 'finally' body
COMPOUND = 'if' NAMED body ('elif' NAMED body)* else? | 'while' NAMED body else? | 'async'? 'for' targets 'in' exprs body else? | 'try' body (excepted+ else? finally? | grouped+ else? finally? | finally) | 'async'? 'with' (ITEM (',' ITEM)* | '(ITEMS)') body | decorated 'async'? 'def' name ('[TPARAMS]')? '(PARAMS)' ('->' EXPR)? body | decorated 'class' name ('[TPARAMS]')? ('(ARGS)')? body | 'match' (NSTAR ',' nexprs? | NAMED) ':' NL '<CASES>'
STMT = SIMPLE | COMPOUND
BLOCK = STMT*
STMTELEMENTS = STMT+
CASE = 'case' PATTERNS ('if' NAMED)? body
CASES = CASE*
CASEELEMENTS = CASE+
number = PM? NUMBER (PM NUMBER)?
value = number | strings | CONST | name ('.' name)+
closed = number | strings | CONST | name ('.' name)* ('(PATARGS)')? | '(PATSEQ)' | '[PATSEQ]' | '{PATMAP}'
PATTERN = closed ('|' closed)* ('as' name)?
maybe = PATTERN | '*' name
PATTERNS = PATTERN | maybe ',' (maybe (',' maybe)* ','?)?
PATSEQ = (maybe (',' maybe)* ','?)?
pkey = name '=' PATTERN
PATARGS = ((PATTERN (',' PATTERN)* (',' pkey)* | pkey (',' pkey)*) ','?)?
mapped = value ':' PATTERN | '**' name
PATMAP = (mapped (',' mapped)* ','?)?
FIELD = (YIELD | exprs) '='?
"""
