"""Parsing-expression grammars of the languages, over the tokens of the lexers. Only syntax counts, not names or types."""

from __future__ import annotations

from functools import lru_cache

from strandwork.llm.parsing.lexers import GO_WORDS, JAVA_WORDS, JS_WORDS, PY_WORDS
from strandwork.llm.syntax.packrat import Grammar

JSON = """
Text <- Value EOF
Value <- STR / NUM / 'true' / 'false' / 'null' / '{' (Pair (',' Pair)*)? '}' / '[' (Value (',' Value)*)? ']'
Pair <- STR ':' Value
"""

# <T .. T> parts are TypeScript's alone
JS = """
Program <- Item* EOF
Item <- Import / Export / Statement
Word <- NAME / KEYWORD
Eos <- ';' / &'}' / @NL / &EOF
Import <- 'import' !'(' !'.' <T ("type" !"from" / "type" &("from" "from"))? T> (ImportClause FromClause / STR Attributes?) Eos <T / 'import' "type"? Ident '=' ("require" '(' STR ')' / Ident ('.' Word)*) Eos T>
ImportClause <- Ident (',' (NameSpace / Named))? / NameSpace / Named
NameSpace <- '*' "as" Ident
Named <- '{' (Specifier (',' Specifier)*)? ','? '}'
Specifier <- <T "type" !"as" !',' !'}' ModName ("as" ModName)? / "type" "as" "as" ModName / T> ModName ("as" ModName)?
ModName <- Word / STR
FromClause <- "from" STR Attributes?
Attributes <- ('with' / @NONL "assert") '{' ((Word / STR) ':' STR (',' (Word / STR) ':' STR)*)? ','? '}'
Export <- Decorator* 'export' ('default' (Function / Class <T / "abstract" Class / Interface T> / Assign Eos) / <T "type"? T> '*' ("as" ModName)? FromClause Eos / <T "type"? T> Named FromClause? Eos / Declaration <T / '=' Expr Eos / "as" "namespace" Ident Eos / 'import' Ident '=' ("require" '(' STR ')' / Ident ('.' Word)*) Eos T>)
Declaration <- FunctionDecl / ClassDecl / Variable Eos / EnumDecl <T / Interface / TypeAlias / Namespace / Declare / "abstract" @NONL ClassDecl T>
EnumDecl <- <T 'const'? 'enum' Ident '{' (EnumItem (',' EnumItem)*)? ','? '}' / T> !'enum' 'enum'
EnumItem <- (Word / STR / '[' (STR / TEMPLATE_FULL) ']') ('=' Assign)?
Interface <- "interface" @NONL Ident TypeParams? ('extends' TypeRef (',' TypeRef)*)? ObjectType
TypeAlias <- "type" @NONL Ident TypeParams? '=' Type Eos
Namespace <- ("namespace" @NONL Ident ('.' Ident)* / "module" @NONL (Ident ('.' Ident)* / STR) / "global") (Block2 / &Eos2 Eos)
Eos2 <- ';' / @NL
Block2 <- '{' (Item / 'export'? Ambient Eos)* '}'
Declare <- "declare" @NONL (FunctionDecl / ClassDecl / "abstract" ClassDecl / Ambient Eos / EnumDecl / Interface / TypeAlias / Namespace)
Ident <- !"let" NAME
Statement <- Block / Variable Eos / ';' / If / For / While / Do / Continue / Break / Return / With / Switch / Throw / Try / 'debugger' Eos / FunctionDecl / ClassDecl / Labelled <T / Interface / TypeAlias / Namespace / Declare / EnumDecl / "abstract" @NONL ClassDecl T> / !'{' !'function' !'class' !("async" @NONL 'function') Expr Eos
Block <- '{' Statement* '}'
Variable <- 'const' <T !'enum' T> Fixed (',' Fixed)* / ('var' / "let" &(NAME / '[' / '{')) Binding (',' Binding)*
Fixed <- Target <T TypeNote? T> '=' Assign
Binding <- Ident <T '!'? TypeNote? T> ('=' Assign)? / Fixed
Ambient <- ('var' / 'const' / "let") Target TypeNote? ('=' Assign)? (',' Target TypeNote? ('=' Assign)?)*
Target <- Ident / '[' (Element? ',')* Element? ']' / '{' (Property (',' Property)*)? ','? '}'
Element <- '...' Target / Target ('=' Assign)?
Property <- '...' Target / PropKey ':' Target ('=' Assign)? / Ident ('=' Assign)?
If <- 'if' '(' Expr ')' Statement ('else' Statement)?
For <- 'for' "await"? '(' (ForDecl ("of" Assign / 'in' Expr) / ForInit? ';' Expr? ';' Expr? / !"let" LeftSide ("of" Assign / 'in' Expr)) ')' Statement
ForDecl <- ('var' / 'const' / "let" / "await"? "using") Target <T TypeNote? T>
ForInit <- ('var' / 'const' / "let" &(NAME / '[' / '{')) BindingNoIn (',' BindingNoIn)* / Expr
BindingNoIn <- Target <T TypeNote? T> ('=' Assign)?
While <- 'while' '(' Expr ')' Statement
Do <- 'do' Statement 'while' '(' Expr ')' ';'?
Continue <- 'continue' (@NONL Ident)? Eos
Break <- 'break' (@NONL Ident)? Eos
Return <- 'return' (@NONL !';' !'}' Expr)? Eos
With <- 'with' '(' Expr ')' Statement
Switch <- 'switch' '(' Expr ')' '{' (('case' Expr / 'default') ':' Statement*)* '}'
Throw <- 'throw' @NONL Expr Eos
Try <- 'try' Block ('catch' ('(' Target <T TypeNote? T> ')')? Block ('finally' Block)? / 'finally' Block)
Labelled <- Ident ':' Statement
FunctionDecl <- ("async" @NONL)? 'function' '*'? Ident <T TypeParams? T> Params <T ReturnNote? T> FunctionBody
ClassDecl <- Decorator* 'class' !'{' !'extends' ClassTail
Function <- ("async" @NONL)? 'function' '*'? Ident? <T TypeParams? T> Params <T ReturnNote? T> FunctionBody
FunctionBody <- Block <T / &Eos2 Eos / &'}' / &EOF T>
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Decorator* <T Access? Modifier* T> ('...' Target / <T 'this' / T> Target) <T '?'? TypeNote? T> ('=' Assign)?
Class <- Decorator* 'class' ClassTail
ClassTail <- <T !"implements" T> Ident? <T TypeParams? T> ('extends' Unary <T TypeArgs? T>)? <T ("implements" TypeRef (',' TypeRef)*)? T> '{' Member* '}'
Decorator <- '@' (NAME ('.' (Word / PRIVATE))* (<T TypeArgs? T> Args)? / '(' Expr ')')
Access <- ("public" / "private" / "protected") !'=' !';' !'(' !':' !'?' !'!' !',' !')' !'}' !'<'
Modifier <- ("readonly" / "abstract" / "override" / "declare" / "accessor" / "static") !'=' !';' !'(' !':' !'?' !'!' !',' !')' !'}' !'<'
Member <- ';' / "static" Block / Decorator* <T Access? Modifier* T> <J ("static" !'=' !';' !'(' !'}' !@NLEND)? J> MemberBody
MemberBody <- <T IndexSignature Eos / T> (("get" / "set") &MemberKey MemberKey Params <T ReturnNote? T> FunctionBody) / ("async" @NONL &('*' / MemberKey))? '*'? MemberKey <T '?'? TypeParams? T> Params <T ReturnNote? T> FunctionBody / ("accessor" @NONL &MemberKey)? MemberKey <T ('?' / '!')? TypeNote? T> ('=' Assign)? Eos
MemberKey <- PRIVATE / PropKey
PropKey <- Word / STR / NUM / '[' Assign ']'
Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / Pattern '=' !'=' Assign / Cond (AssignOp Assign)?
Pattern <- &('[' / '{') Target &'='
LeftSide <- Pattern2 / Postfix
Pattern2 <- &('[' / '{') Target
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' @ADJ '>=' / '>' @ADJ '>' @ADJ '>=' / '&=' / '^=' / '|=' / '&&=' / '||=' / '??='
Yield <- 'yield' / "yield" (@NONL '*' Assign / @NONL Assign)?
Arrow <- ("async" @NONL)? (Ident / <T TypeParams? T> Params <T ReturnNote? T>) @NONL '=>' (Block / !'{' Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (<T @NONL ("as" / "satisfies") ('const' / Type) / T> BinOp Unary)*
BinOp <- '+' / '-' / '*' / '/' / '%' / '**' / '<<' / '<=' / '<' / '>' (@ADJ '>=' !'=' / @ADJ '>' (@ADJ '>')? / '=' )? !'>=' / '>=' / '==' / '!=' / '===' / '!==' / '&&' / '||' / '??' / '&' / '|' / '^' / 'in' / 'instanceof'
Unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / "await" @NONLAWAIT) Unary / <A '<' Type '>' Unary / A> Postfix
Postfix <- Call (@NONL ('++' / '--'))?
Call <- ('new' NewTail / Primary) CallTail*
NewTail <- '.' "target" / ('new' NewTail / Primary) NewPart* <T (TypeArgs &'(')? T> Args?
NewPart <- '.' (Word / PRIVATE) / '[' Expr ']' / Template <T / @NONL '!' !'=' T>
CallTail <- '.' (Word / PRIVATE) / '?.' (Args / '[' Expr ']' / Template / PRIVATE / Word) / '[' Expr ']' / Args / Template <T / @NONL '!' / TypeArgs &('(' / TEMPLATE_START / TEMPLATE_FULL) (Args / Template) / TypeArgs !Operand T>
Operand <- NAME / NUM / STR / '(' / '[' / '{' / '+' / '-' / 'new' / 'this'
Args <- '(' ((('...')? Assign) (',' ('...')? Assign)* ','?)? ')'
Template <- TemplateText / TEMPLATE_FULL
TemplateText <- TEMPLATE_START Expr (TEMPLATE_MIDDLE Expr)* TEMPLATE_END
Primary <- 'this' / 'super' / 'null' / 'true' / 'false' / NUM / STR / TEMPLATE_FULL / REGEX / TemplateText / Function / Class / ObjectLit / ArrayLit / '(' Expr ')' / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' Word) / PRIVATE &'in' / Markup / Ident
Markup <- JSX_OPEN (JSX_HOLE ('...'? Expr)? JSX_END)* JSX_CLOSE
ArrayLit <- '[' ','* ('...'? Assign (','+ '...'? Assign)*)? ','* ']'
ObjectLit <- '{' (ObjectItem (',' ObjectItem)*)? ','? '}'
ObjectItem <- '...' Assign / ("get" / "set") &MemberKey MemberKey Params <T ReturnNote? T> Block / ("async" @NONL &('*' / MemberKey))? '*'? MemberKey <T TypeParams? T> Params <T ReturnNote? T> Block / PropKey ':' Assign / Ident ('=' Assign)?
"""

TYPES = """
TypeNote <- ':' Type
ReturnNote <- ':' (Predicate / Type)
Predicate <- "asserts" @NONL (NAME / 'this') ("is" Type)? / (NAME / 'this') @NONL "is" Type
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / "out" &NAME)* Ident ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* ','? '>'
Type <- FunctionType / UnionType ('extends' UnionType '?' Type ':' Type)?
FunctionType <- ("abstract"? 'new')? TypeParams? Params '=>' (Predicate / Type)
UnionType <- '|'? InterType ('|' InterType)*
InterType <- '&'? PrefixType ('&' PrefixType)*
PrefixType <- ("keyof" / "unique" / "readonly") PrefixType / "infer" Ident ('extends' UnionType !'?')? / PostType
PostType <- BaseType (@NONL '[' Type? ']')*
BaseType <- '(' Type ')' / 'typeof' ('import' '(' Type ')' ('.' Word)* / (NAME / 'this') ('.' (Word / PRIVATE))*) TypeArgs? / 'import' '(' Type (',' ObjectLit)? ')' ('.' Word)* TypeArgs? / MappedType / ObjectType / TupleType / '-'? NUM / STR / TEMPLATE_FULL / TEMPLATE_START Type (TEMPLATE_MIDDLE Type)* TEMPLATE_END / 'void' / 'null' / 'this' / 'true' / 'false' / TypeRef
TypeRef <- NAME ('.' Word)* (@NONL TypeArgs)?
TupleType <- '[' (TupleItem (',' TupleItem)*)? ','? ']'
TupleItem <- '...'? Word '?'? ':' '...'? Type / '...'? Type '?'?
MappedType <- '{' (('+' / '-')? "readonly")? '[' Ident 'in' Type ("as" Type)? ']' (('+' / '-')? '?')? (':' Type)? ';'? '}'
ObjectType <- '{' (TypeMember (',' / ';' / @NL / &'}'))* '}'
TypeMember <- IndexSignature / ("get" / "set") &MemberKey MemberKey Params ReturnNote? / ("readonly" &(MemberKey))? MemberKey '?'? (TypeParams? Params ReturnNote? / TypeNote)? / 'new'? TypeParams? Params ReturnNote?
IndexSignature <- (("static" / "readonly"))* '[' Ident ':' Type ']' TypeNote?
"""

GO = """
File <- 'package' NAME Semi ImportDecl* TopDecl* EOF
Semi <- ';' / &')' / &'}' / &EOF
ImportDecl <- 'import' (ImportSpec / '(' (ImportSpec Semi)* ')') Semi
ImportSpec <- ('.' / NAME)? STR
TopDecl <- (Func / Decl) Semi
Func <- 'func' (Params NAME / NAME TypeParams?) Params Result? Block?
Decl <- 'const' Group_Const / 'var' Group_Var / 'type' Group_Type
Group_Const <- '(' (ConstSpec Semi)* ')' / ConstSpec
Group_Var <- '(' (VarSpec Semi)* ')' / VarSpec
Group_Type <- '(' (TypeSpec Semi)* ')' / TypeSpec
ConstSpec <- Names (Type? '=' Exprs)?
VarSpec <- Names (Type ('=' Exprs)? / '=' Exprs)
TypeSpec <- NAME (TypeParams !(Semi) / TypeParams?) '='? Type
Names <- NAME (',' NAME)*
TypeParams <- '[' Names Constraint (',' Names Constraint)* ','? ']'
Constraint <- '~'? Type ('|' '~'? Type)*
Type <- TypeName / '*' Type / 'func' Signature / '[' ']' Type / '[' ('...' / Expr) ']' Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type / Struct / InterfaceType / '(' Type ')'
TypeName <- NAME ('.' NAME)? ('[' Type (',' Type)* ','? ']')?
Struct <- 'struct' '{' (FieldDecl Semi)* '}'
FieldDecl <- (Names Type / '*'? TypeName / '(' '*'? TypeName ')') STR?
InterfaceType <- 'interface' '{' ((NAME Signature / Constraint) Semi)* '}'
Signature <- Params Result?
Result <- Params / Type
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- NAME '...' Type / NAME Type / '...' Type / Type
Block <- '{' Statements '}'
Statements <- (Statement? ';')* Statement?
Statement <- Decl / Block / If / For / Switch / Select / 'return' Exprs? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / 'go' Expr / 'defer' Expr / Label / Simple
Label <- NAME ':' !'=' (&'}' / ';'? Statement?)
Simple <- Exprs (':=' ('range' Expr / Exprs) / AssignOp ('range' Expr / Exprs) / '++' / '--' / '<-' Expr)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
If <- 'if' (HSimple? ';')? HExpr Block ('else' (If / Block))?
HSimple <- HExprs (':=' HExprs / AssignOp HExprs / '++' / '--' / '<-' HExpr)?
For <- 'for' (ForRange / HSimple? ';' HExpr? ';' HSimple? / HSimple? ';' HExpr? / HExpr)? Block
ForRange <- (HExprs (':=' / '='))? 'range' HExpr
Switch <- 'switch' (HSimple? ';')? (TypeGuard / HSimple)? '{' Case* '}'
TypeGuard <- (NAME ':=')? HPrimary &'.' '.' '(' 'type' ')' / (NAME ':=')? GuardHead
GuardHead <- HOperand (!('.' '(' 'type') HTail)* '.' '(' 'type' ')'
Case <- ('case' CaseItem (',' CaseItem)* / 'default') ':' Statements
CaseItem <- Expr / Type
Select <- 'select' '{' (('case' Simple / 'default') ':' Statements)* '}'
Exprs <- Expr (',' Expr)*
HExprs <- HExpr (',' HExpr)*
Expr <- Unary (BinOp Unary)*
HExpr <- HUnary (BinOp HUnary)*
BinOp <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '&^' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&'
Unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') Unary / Primary
HUnary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') HUnary / HPrimary
Primary <- Operand Tail*
HPrimary <- HOperand HTail*
Operand <- Literal / FuncLit / '(' (Expr / Type) ')' / Composite / TypeConv / NAME
HOperand <- Literal / FuncLit / '(' (Expr / Type) ')' / HComposite / TypeConv / NAME
Literal <- NUM / STR
FuncLit <- 'func' Signature Block
TypeConv <- ('[' ']' Type / '[' Expr ']' Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Signature / InterfaceType / Struct) &('(' / ')' / ',' / ';' / '{')
Composite <- (ArrayLike / TypeName) Braces
HComposite <- ArrayLike Braces
ArrayLike <- '[' ']' Type / '[' ('...' / Expr) ']' Type / 'map' '[' Type ']' Type / Struct
Braces <- '{' (Keyed (',' Keyed)* ','?)? '}'
Keyed <- Value (':' Value)?
Value <- Braces / Expr
Tail <- '.' (NAME / '(' (Type / 'type') ')') / Index / CallArgs / TypedBraces
HTail <- '.' (NAME / '(' (Type / 'type') ')') / Index / CallArgs
TypedBraces <- !'{' Braces
Index <- '[' (Expr? ':' Expr? (':' Expr)? / (Expr / Type) (',' (Expr / Type))* ','?) ']'
CallArgs <- '(' ((Expr / Type) (',' (Expr / Type))* '...'? ','?)? ')'
"""

JAVA = """
Unit <- (Annotation* 'package' Qualified ';')? (Import / ';')* (TypeDecl / ';')* EOF / ModuleDecl EOF
ModuleDecl <- Import* Annotation* "open"? "module" Qualified '{' ((NAME / 'transient' / 'static' / 'package')+ (Qualified (',' Qualified)*)? (("to" / "with") Qualified (',' Qualified)*)? ';')* '}'
Import <- 'import' 'static'? Qualified ('.' '*')? ';'
Qualified <- NAME ('.' NAME)*
TypeDecl <- Modifier* (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl / AnnotationDecl)
Modifier <- Annotation / 'public' / 'private' / 'protected' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' !'->' / "sealed" &Following / "non" '-' "sealed"
Following <- 'class' / 'interface' / 'abstract' / 'public' / 'private' / 'protected' / 'static' / 'final' / 'strictfp' / '@'
Annotation <- '@' !'interface' Qualified ('(' (Pair (',' Pair)* ','? / ElementValue)? ')')?
Pair <- NAME '=' ElementValue
ElementValue <- Annotation / '{' (ElementValue (',' ElementValue)*)? ','? '}' / Cond
ClassDecl <- 'class' NAME TypeParams? ('extends' Type)? ('implements' Types)? ("permits" Types)? ClassBody
InterfaceDecl <- 'interface' NAME TypeParams? ('extends' Types)? ("permits" Types)? ClassBody
AnnotationDecl <- '@' 'interface' NAME ClassBody
EnumDecl <- 'enum' NAME ('implements' Types)? '{' (Constant (',' Constant)*)? ','? (';' Member*)? '}'
Constant <- Annotation* NAME Args? ClassBody?
RecordDecl <- "record" NAME TypeParams? '(' (Component (',' Component)*)? ')' ('implements' Types)? ClassBody
Component <- Annotation* Type '...'? NAME
Types <- Type (',' Type)*
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annotation* NAME ('extends' Type ('&' Type)*)?
ClassBody <- '{' Member* '}'
Member <- ';' / 'static'? Block / TypeDecl / Modifier* TypeParams? (Method / Field)
Method <- (('void' / Type) NAME / NAME) Formals Dims ('throws' Types)? (Block / ('default' ElementValue)? ';') / NAME Block
Formals <- '(' (Formal (',' Formal)*)? ')'
Formal <- ('final' / Annotation)* Type Annotation* ('...' NAME / ((NAME '.')? 'this') / NAME Dims)
Field <- Type Declarators ';'
Declarators <- Declarator (',' Declarator)*
Declarator <- (NAME / '_') Dims ('=' Init)?
Dims <- (Annotation* '[' ']')*
Init <- ArrayInit / Expr
ArrayInit <- '{' (Init (',' Init)*)? ','? '}'
Type <- Annotation* (Primitive / ClassType) Dims
Primitive <- 'int' / 'long' / 'boolean' / 'double' / 'float' / 'char' / 'byte' / 'short'
ClassType <- NAME TypeArgs? ('.' Annotation* NAME TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annotation* '?' (('extends' / 'super') Type)? / Type
Block <- '{' BlockItem* '}'
BlockItem <- LocalClass / LocalVar ';' / Statement
LocalClass <- ('final' / 'abstract' / 'static' / 'strictfp' / Annotation / "sealed" / "non" '-' "sealed")* (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl)
LocalVar <- ('final' / Annotation)* Type Declarators
Statement <- Block / ';' / If / While / Do / For / Switch / Try / 'return' Expr? ';' / 'throw' Expr ';' / 'break' NAME? ';' / 'continue' NAME? ';' / 'synchronized' '(' Expr ')' Block / 'assert' Expr (':' Expr)? ';' / Yield / NAME ':' Statement / StatementExpr ';'
Yield <- "yield" !'=' !'.' !'++' !'--' !'[' Expr ';'
If <- 'if' '(' Expr ')' Statement ('else' Statement)?
While <- 'while' '(' Expr ')' Statement
Do <- 'do' Statement 'while' '(' Expr ')' ';'
For <- 'for' '(' (('final' / Annotation)* Type NAME ':' Expr / (LocalVar / StatementExpr (',' StatementExpr)*)? ';' Expr? ';' (StatementExpr (',' StatementExpr)*)?) ')' Statement
Switch <- 'switch' '(' Expr ')' SwitchBody
SwitchBody <- '{' (Label ('->' (Block / 'throw' Expr ';' / Expr ';') / ':' BlockItem*))* '}'
Label <- 'case' CaseItem (',' CaseItem)* ("when" Expr)? / 'default'
CaseItem <- 'default' / 'null' / Pattern &("when" / ',' / '->' / ':') / Cond
Pattern <- ('final' / Annotation)* Type (NAME / '_') / Type '(' (Pattern (',' Pattern)*)? ')' / '_'
Try <- 'try' (Resources Block (Catch+ Finally? / Finally)? / Block (Catch+ Finally? / Finally))
Resources <- '(' Resource (';' Resource)* ';'? ')'
Resource <- ('final' / Annotation)* Type (NAME / '_') '=' Expr / Primary
Catch <- 'catch' '(' ('final' / Annotation)* Type ('|' Type)* (NAME / '_') ')' Block
Finally <- 'finally' Block
StatementExpr <- ('++' / '--') Unary / Primary (AssignOp Expr / '++' / '--') / CallOrNew
CallOrNew <- Base (Selector &SelectorStart)* CallEnd / NewBase !SelectorStart / CallBase !SelectorStart
CallBase <- NAME Args / ('this' / 'super') Args
CallEnd <- ('.' (TypeArgs? NAME Args / TypeArgs? 'super' Args / 'new' TypeArgs? Creator))
NewBase <- 'new' Creator
SelectorStart <- '.' / '[' / '::'
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '&=' / '|=' / '^=' / '%=' / '<<=' / '>' @ADJ '>=' / '>' @ADJ '>' @ADJ '>=' / '>='  !'='
Lambda <- (NAME / '_' / '(' (LambdaParams / Formal (',' Formal)*)? ')') '->' (Block / Expr)
LambdaParams <- (NAME / '_') (',' (NAME / '_'))* &')'
Cond <- Binary ('?' (Lambda / Expr) ':' (Lambda / Cond))?
Binary <- Unary (BinOp Unary / 'instanceof' (Pattern / 'final'? Type))*
BinOp <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>' @ADJ '>' @ADJ '>' !('>') / '>' @ADJ '>' / '>' @ADJ '=' / '>' / '+' / '-' / '*' / '/' / '%' / '|' / '^' / '&'
Unary <- ('++' / '--' / '+' / '-' / '!' / '~') Unary / Cast / Primary ('++' / '--')*
Cast <- '(' Primitive Dims ')' Unary / '(' Type ('&' Type)* ')' (Lambda / &CastEnd Unary)
CastEnd <- NAME / STR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / 'int' / 'long' / 'boolean' / 'double' / 'float' / 'char' / 'byte' / 'short' / 'void'
Primary <- Base Selector*
Base <- STR / NUM / 'true' / 'false' / 'null' / 'new' Creator / ('this' / 'super') Args? / 'switch' '(' Expr ')' SwitchBody / '(' Expr ')' / 'void' '.' 'class' / Primitive Dims ('.' 'class' / '::' 'new') / ClassType Dims '::' TypeArgs? (NAME / 'new') / NAME Dims2 '.' 'class' / NAME Args / NAME
Dims2 <- ('.' NAME)* '[' ']' Dims
Selector <- '.' (TypeArgs? NAME Args? / 'this' / 'class' / TypeArgs? 'super' Args? / 'new' TypeArgs? Creator) / '[' Expr ']' / '::' TypeArgs? (NAME / 'new')
Creator <- Annotation* (Primitive / NAME TypeArgs? ('.' Annotation* NAME TypeArgs?)*) (Args ClassBody? / ('[' Expr ']')+ Dims / ('[' ']')+ ArrayInit)
Args <- '(' (Expr (',' Expr)*)? ')'
"""

PYTHON = """
File <- (NEWLINE / Statement)* EOF
Statement <- Compound / SimpleLine
SimpleLine <- Simple (';' Simple)* ';'? NEWLINE
Block <- NEWLINE INDENT Statement+ DEDENT / SimpleLine
Simple <- Assignment / TypeAlias / Return / Import / Raise / 'pass' / Del / Assert / 'break' / 'continue' / ('global' / 'nonlocal') NAME (',' NAME)* / StarExprs
Compound <- Decorators? (FuncDef / ClassDef) / If / With / For / Try / While / Match
Assignment <- (Attribute / NAME / '(' SingleTarget ')') ':' Expression ('=' Annotated)? / (StarTargets '=' !'=')+ (Yield / StarExprs) !'=' / SingleTarget AugOp (Yield / StarExprs)
Annotated <- Yield / StarExprs
AugOp <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
TypeAlias <- "type" NAME TypeParams? '=' Expression
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- '*' NAME ('=' StarExpr)? / '**' NAME ('=' Expression)? / NAME (':' Expression)? ('=' Expression)?
Return <- 'return' StarExprs?
Raise <- 'raise' (Expression ('from' Expression)?)?
Del <- 'del' DelTargets &(';' / NEWLINE)
DelTargets <- DelTarget (',' DelTarget)* ','?
DelTarget <- Attribute / NAME / '(' DelTargets? ')' / '[' DelTargets? ']'
Assert <- 'assert' Expression (',' Expression)?
Import <- 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* / 'from' ('.' / '...')* Dotted 'import' ImportNames / 'from' ('.' / '...')+ 'import' ImportNames
ImportNames <- '(' ImportName (',' ImportName)* ','? ')' / ImportName (',' ImportName)* !',' / '*'
ImportName <- NAME ('as' NAME)?
Dotted <- NAME ('.' NAME)*
Decorators <- ('@' Named NEWLINE)+
ClassDef <- 'class' NAME TypeParams? ('(' Arguments? ')')? ':' Block
FuncDef <- 'async'? 'def' NAME TypeParams? '(' Parameters? ')' ('->' Expression)? ':' Block
Parameters <- PosParams (',' StarParams)? ','? / StarParams ','?
PosParams <- Plain (',' Plain)* (',' '/' (',' Plain)* (',' Default)* / (',' Default)* (',' '/' (',' Default)*)?) / Default (',' Default)* (',' '/' (',' Default)*)?
Plain <- NAME (':' Expression)? !'='
Default <- NAME (':' Expression)? '=' Expression
Param <- NAME (':' Expression)? ('=' Expression)?
StarParams <- '*' (NAME (':' StarExpr)? (',' Param)* / (',' Param)+) (',' KwParam)? / KwParam
KwParam <- '**' NAME (':' Expression)?
If <- 'if' Named ':' Block ('elif' Named ':' Block)* Else?
Else <- 'else' ':' Block
While <- 'while' Named ':' Block Else?
For <- 'async'? 'for' StarTargets 'in' StarExprs ':' Block Else?
With <- 'async'? 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' Block / WithItem (',' WithItem)* ':' Block)
WithItem <- Expression ('as' StarTarget &(',' / ')' / ':'))?
Try <- 'try' ':' Block (Finally / Except+ Else? Finally?)
Except <- 'except' ('*'? Expression ('as' NAME)?)? ':' Block
Finally <- 'finally' ':' Block
Match <- "match" Subject ':' NEWLINE INDENT Case+ DEDENT
Subject <- StarNamed ',' StarNameds? / Named
Case <- "case" Patterns ('if' Named)? ':' Block
Patterns <- OpenSequence / AsPattern
OpenSequence <- MaybeStar ',' (MaybeStar (',' MaybeStar)* ','?)?
MaybeStar <- '*' NAME / AsPattern
AsPattern <- OrPattern ('as' NAME)?
OrPattern <- ClosedPattern ('|' ClosedPattern)*
ClosedPattern <- ComplexNumber / Strings / 'None' / 'True' / 'False' / Dotted '(' (PatternArg (',' PatternArg)* ','?)? ')' / Dotted / '(' (OpenSequence / AsPattern)? ')' / '[' (MaybeStar (',' MaybeStar)* ','?)? ']' / '{' (MapItem (',' MapItem)* ','?)? '}'
ComplexNumber <- '-'? NUM (('+' / '-') NUM)?
PatternArg <- NAME '=' AsPattern / AsPattern
MapItem <- '**' NAME / (ComplexNumber / Strings / 'None' / 'True' / 'False' / Dotted) ':' AsPattern
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / Expression / Yield
Yield <- 'yield' ('from' Expression / StarExprs)?
StarNameds <- StarNamed (',' StarNamed)* ','?
StarNamed <- '*' BitOr / Named
Named <- NAME ':=' Expression / Expression !':='
Expression <- Lambda / Or ('if' Or 'else' Expression)?
Lambda <- 'lambda' LambdaParams? ':' Expression
LambdaParams <- LambdaPos (',' LambdaStar)? ','? / LambdaStar ','?
LambdaPos <- LPlain (',' LPlain)* (',' '/' (',' LPlain)* (',' LDefault)* / (',' LDefault)* (',' '/' (',' LDefault)*)?) / LDefault (',' LDefault)* (',' '/' (',' LDefault)*)?
LPlain <- NAME !'='
LDefault <- NAME '=' Expression
LambdaParam <- NAME ('=' Expression)?
LambdaStar <- '*' (NAME (',' LambdaParam)* / (',' LambdaParam)+) (',' '**' NAME)? / '**' NAME
Or <- And ('or' And)*
And <- Not ('and' Not)*
Not <- 'not' Not / Comparison
Comparison <- BitOr (CompOp BitOr)*
CompOp <- '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
BitOr <- Factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@') Factor)*
Factor <- ('+' / '-' / '~') Factor / Power
Power <- 'await'? Primary ('**' Factor)?
Primary <- Atom Trailer*
Trailer <- '.' NAME / '(' Arguments? ')' / '[' Slices ']'
TrailerStart <- '.' / '(' / '['
Atom <- NAME / 'True' / 'False' / 'None' / '...' / NUM / Strings / Group / ListLike / Braced
Strings <- STR+ / BYTES+
Group <- '(' (Yield / Named CompFor / StarNamed ',' StarNameds? / Named)? ')'
ListLike <- '[' (Named CompFor / StarNameds)? ']'
Braced <- '{' (DictItem CompFor / DictItem (',' DictItem)* ','? / Named CompFor / StarNameds)? '}'
DictItem <- '**' BitOr / Expression ':' Expression
CompFor <- ('async'? 'for' StarTargets 'in' Or ('if' CompIf)*)+
CompIf <- Or
Slices <- Slice !',' / SliceItem (',' SliceItem)* ','?
SliceItem <- '*' BitOr / Slice
Slice <- Expression? ':' Expression? (':' Expression?)? / Named
Arguments <- (Positional (',' Positional)* (',' KeyArg (',' (KeyArg / '*' Expression / StarArg2))*)? / KeyArg (',' (KeyArg / '*' Expression))*) ','? &')'
StarArg2 <- '*' Expression
Positional <- '*' Expression / !(NAME '=') (NAME ':=' Expression / Expression !':=') CompFor? 
KeyArg <- NAME '=' Expression / '**' Expression
StarTargets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' !'*' TargetAtom / TargetAtom
TargetAtom <- Attribute / NAME !TrailerStart / '(' StarTargets? ')' !TrailerStart / '[' StarTargets? ']' !TrailerStart
SingleTarget <- Attribute / NAME / '(' SingleTarget ')'
Attribute <- Atom (Trailer &TrailerStart)* ('.' NAME / '[' Slices ']') !TrailerStart
"""


#: Statements that may hold statements; outside functions none of them may hold a return.
_STATEMENTS = ("Statement", "Block", "If", "For", "While", "Do", "With", "Switch", "Try", "Labelled")


def _js(types: bool, angle: bool) -> str:
    import re

    def part(mark: str, keep: bool, text: str) -> str:
        return re.sub(rf"<{mark} (.*?) {mark}>", (lambda m: m.group(1)) if keep else "", text)

    text = JS
    # parts may lie within parts of another mark, never of their own
    text = part("A", angle and types, text)
    text = part("J", not types, text)
    text = part("T", types, text)
    rules = dict(line.split(" <- ", 1) for line in text.strip().split("\n"))
    top = re.compile(rf"(?<![\w'\"])(?:{'|'.join(_STATEMENTS)})(?!\w)")
    outside = lambda body: top.sub(lambda m: "Top" + m.group(), body)
    for r in _STATEMENTS:
        rules["Top" + r] = outside(rules[r].replace(" / Return /", " /"))
    rules["Item"] = outside(rules["Item"])
    text = "\n".join(f"{r} <- {body}" for r, body in rules.items()) + "\n"
    text = text.replace("@NONLAWAIT", "").replace("!(NAME_IN_OF)", "").replace("!@NLEND", "")
    return text + (TYPES if types else "")


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The grammar of 'json', 'js', 'ts', 'tsx', 'go', 'java' or 'python'."""
    if language in ("js", "ts", "tsx"):
        return Grammar(_js(language != "js", language == "ts"), "Program", {"KEYWORD": set(JS_WORDS)})
    text, start, words = {
        "json": (JSON, "Text", ()), "go": (GO, "File", GO_WORDS), "java": (JAVA, "Unit", JAVA_WORDS), "python": (PYTHON, "File", PY_WORDS),
    }[language]
    return Grammar(text, start, {"KEYWORD": set(words)})
