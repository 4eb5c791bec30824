"""Grammars of the source languages, over tokens in which each bracketed part is one terminal.

Token classes: ID NUM STR CHR names and literals; LIT true, null and the like; PM + and -; UN other prefix signs; INC ++ and --; BIN other infix
signs; AUG compound assignment; PRIM built-in types; MOD modifiers; NL a line end that may end a statement; TPL JSX REGEX as in their languages.
LISTS names the nonterminals whose sentences may be parted at statement ends and recognised piece by piece.
"""

JAVA = """
Unit = TopItem*
TopItem = Annot* 'package' Qual ';' | 'import' 'static'? Qual ( '.' '*' )? ';' | Mods TypeDecl | ';' | Mods 'module' Qual {:Block:}
Qual = ID ( '.' ID )*
Annot = '@' Qual (:AnnArgs:)?
AnnArgs = ( AnnVal ( ',' AnnVal )* )?
AnnVal = ( ID '=' )? ( Expr | {:AnnList:} | Annot )
AnnList = ( AnnVal ( ',' AnnVal )* ','? )?
Mods = ( MOD | Annot )*
TypeDecl = 'class' ID TParams? ( 'extends' Type )? ( 'implements' Types )? ( 'permits' Types )? {:ClassBody:} | 'interface' ID TParams? ( 'extends' Types )? ( 'permits' Types )? {:ClassBody:} | 'enum' ID ( 'implements' Types )? {:EnumBody:} | '@' 'interface' ID {:ClassBody:} | 'record' ID TParams? (:Params:) ( 'implements' Types )? {:ClassBody:}
EnumBody = ( EnumConst ( ',' EnumConst )* )? ','? ( ';' ClassBody )?
EnumConst = Annot* ID (:Args:)? {:ClassBody:}?
ClassBody = Member*
Member = ';' | Mods {:Block:} | Mods TypeDecl | Mods TParams? Type ID (:Params:) Dims Throws? ( {:Block:} | ';' | 'default' AnnVal ';' ) | Mods TParams? ID (:Params:) Throws? {:Block:} | Mods ID {:Block:} | Mods Type VarDecls ';'
Throws = 'throws' Types
Types = Type ( ',' Type )*
Type = Annot* ( PRIM | 'void' | ClassType ) Dims
ClassType = ID TArgs? ( '.' Annot* ID TArgs? )*
TArgs = '<' ( TArg ( ',' TArg )* )? '>'
TArg = Type | Annot* '?' ( ( 'extends' | 'super' ) Type )?
TParams = '<' TParam ( ',' TParam )* '>'
TParam = Annot* ID ( 'extends' Type ( '&' Type )* )?
Dims = ( [:Empty:] )*
Empty =
VarDecls = VarDecl ( ',' VarDecl )*
VarDecl = ID Dims ( '=' ( Expr | {:ArrItems:} ) )?
ArrItems = ( ArrItem ( ',' ArrItem )* ','? )? | ','
ArrItem = Expr | {:ArrItems:}
Params = ( Param ( ',' Param )* )?
Param = Mods Type Annot* '...'? ( ID Dims | ( ID '.' )? 'this' )
LParams = ( ID ( ',' ID )* )? | Params
Block = Stmt*
Stmt = {:Block:} | ';' | Mods Type VarDecls ';' | Mods TypeDecl | SExpr ';' | 'if' (:Cond:) Stmt ( 'else' Stmt )? | 'while' (:Cond:) Stmt | 'do' Stmt 'while' (:Cond:) ';' | 'for' (:ForCtl:) Stmt | 'switch' (:Cond:) {:SwBody:} | 'try' {:Block:} ( Catch+ Finally? | Finally ) | 'try' (:Res:) {:Block:} Catch* Finally? | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'synchronized' (:Cond:) {:Block:} | ID ':' Stmt | 'assert' Expr ( ':' Expr )? ';' | 'yield' Expr ';'
Catch = 'catch' (:CatchPar:) {:Block:}
CatchPar = Mods Type ( '|' Type )* ID
Finally = 'finally' {:Block:}
Res = Resource ( ';' Resource )* ';'?
Resource = Mods Type ID '=' Expr | Expr
Cond = Expr
ForCtl = ForInit? ';' Expr? ';' ( Expr ( ',' Expr )* )? | Mods Type ID ':' Expr
ForInit = Mods Type VarDecls | Expr ( ',' Expr )*
SwBody = SwItem*
SwItem = ( 'case' CaseVal ( ',' CaseVal )* ( 'when' Expr )? | 'default' ) ( ':' | '->' ( Expr ';' | {:Block:} | 'throw' Expr ';' ) ) | Stmt
CaseVal = Tern | 'default' | Pattern
Pattern = Mods Type ID | Type (:Patterns:) ID?
Patterns = ( Pattern ( ',' Pattern )* )?
SExpr = Expr
Expr = Operand ( InOp Operand )* | Lambda | Operand ( InOp Operand )* InOp Lambda
Tern = Operand ( InOp Operand )*
InOp = BIN | PM | '*' | '<' | '>' | '<' '<' | '>' '>' | '>' '>' '>' | '&' | '|' | '?' Expr ':' | '=' | AUG
Operand = Prefix* Postfixed ( 'instanceof' 'final'? ( Type | Pattern ) )?
Prefix = PM | UN | INC | (:CastT:)
CastT = Type ( '&' Type )*
Postfixed = Primary Suffix* INC? | (:CastT:) Lambda
Primary = ID (:Args:)? | NUM | STR | CHR | LIT | ( 'this' | 'super' ) (:Args:)? | (:Cond:) | 'new' New | PRIM Dims '.' 'class' | 'void' '.' 'class' | ClassType [:Empty:] Dims '.' 'class' | Type '::' ( ID | 'new' ) | 'switch' (:Cond:) {:SwBody:}
New = Annot* ClassType (:Args:) {:ClassBody:}? | ( PRIM | ClassType ) ( [:Cond:] )+ Dims | ( PRIM | ClassType ) [:Empty:] Dims {:ArrItems:}
Suffix = '.' TArgs? ( ID | 'super' | 'this' ) (:Args:)? | '.' 'class' | '.' 'new' New | [:Cond:] | '::' TArgs? ( ID | 'new' )
Args = ( Expr ( ',' Expr )* )?
Lambda = ( ID | (:LParams:) ) '->' ( Expr | {:Block:} )
"""

CSHARP = """
Unit = ( NsItem | TopStmt )*
NsItem = 'extern' ID ID ';' | 'global'? 'using' 'static'? ( ID '=' )? Type ';' | 'namespace' Qual ( {:Unit:} ';'? | ';' ) | Attrs Mods TypeDecl | ';' | Attrs
TopStmt = Stmt
Qual = ID ( ( '.' | '::' ) ID )*
Attrs = ( [:AttrList:] )*
AttrList = ( ( ID | 'return' | 'event' ) ':' )? Attr ( ',' Attr )* ','?
Attr = Qual TArgs? (:AttrArgs:)?
AttrArgs = ( AttrArg ( ',' AttrArg )* )?
AttrArg = ( ID ( '=' | ':' ) )? Expr
Mods = MOD*
TypeDecl = ( 'class' | 'struct' | 'interface' | 'record' ( 'class' | 'struct' )? ) ID TParams? (:Params:)? Bases? Where* ( {:ClassBody:} ';'? | ';' ) | 'enum' ID ( ':' Type )? {:EnumBody:} ';'? | 'delegate' Type ID TParams? (:Params:) Where* ';'
Bases = ':' Type (:Args:)? ( ',' Type )*
Where = 'where' ID ':' Constraint ( ',' Constraint )*
Constraint = Type | 'class' '?'? | 'struct' | 'new' (:Empty:) | 'default'
Empty =
EnumBody = ( EnumConst ( ',' EnumConst )* ','? )?
EnumConst = Attrs ID ( '=' Expr )?
ClassBody = Member*
Member = ';' | Attrs Mods TypeDecl | Attrs Mods Type ( Explicit )? ID TParams? (:Params:) Where* Body | Attrs Mods ID (:Params:) ( ':' ( 'base' | 'this' ) (:Args:) )? Body | Attrs Mods 'UN' ID (:Params:) Body | Attrs Mods Type Explicit? ID ( {:Accessors:} ( '=' Expr ';' )? | '=>' Expr ';' ) | Attrs Mods Type Explicit? 'this' [:Params:] ( {:Accessors:} | '=>' Expr ';' ) | Attrs Mods Type VarDecls ';' | Attrs Mods 'event' Type ( VarDecls ';' | Explicit? ID {:Accessors:} ) | Attrs Mods Type 'operator' OpName (:Params:) Body | Attrs Mods ( 'implicit' | 'explicit' ) 'operator' Type (:Params:) Body
Explicit = ( ID TArgs? '.' )+
OpName = BIN | PM | UN | INC | '*' | '<' | '>' | '<' '<' | '>' '>' | '&' | '|' | LIT
Body = {:Block:} ';'? | '=>' 'throw'? Expr ';' | ';'
Accessors = ( Attrs Mods ( 'get' | 'set' | 'init' | 'add' | 'remove' ) Body )+
Type = ( PRIM | 'void' | Qual2 | (:TupleT:) | 'ref' Type ) TypeEnd*
TypeEnd = '?' | '*' | [:Ranks:]
Ranks = ','*
Qual2 = ( ID '::' )? ID TArgs? ( '.' ID TArgs? )*
TArgs = '<' ( Type ( ',' Type )* )? '>' | '<' ','+ '>'
TParams = '<' TParam ( ',' TParam )* '>'
TParam = Attrs ( 'in' | 'out' )? ID
TupleT = Type ID? ( ',' Type ID? )+
VarDecls = VarDecl ( ',' VarDecl )*
VarDecl = ID ( '=' Init )?
Init = Expr | {:InitItems:}
InitItems = ( InitItem ( ',' InitItem )* ','? )?
InitItem = Expr | {:InitItems:} | [:Args:] '=' Init | ID '=' {:InitItems:}
Params = ( Param ( ',' Param )* )?
Param = Attrs ( MOD | 'this' | 'ref' | 'out' | 'in' | 'params' )* Type ID ( '=' Expr )?
LParams = ( LParam ( ',' LParam )* )?
LParam = Attrs ( 'ref' | 'out' | 'in' )? ( Type )? ID ( '=' Expr )?
Block = Stmt*
Stmt = {:Block:} | ';' | MOD* Type VarDecls ';' | Attrs MOD* Type ID TParams? (:Params:) Where* Body | Expr ';' | 'if' (:Cond:) Stmt ( 'else' Stmt )? | 'while' (:Cond:) Stmt | 'do' Stmt 'while' (:Cond:) ';' | 'for' (:ForCtl:) Stmt | 'await'? 'foreach' (:EachCtl:) Stmt | 'switch' (:Args:) {:SwBody:} | 'try' {:Block:} ( Catch+ Finally? | Finally ) | 'return' Expr? ';' | 'throw' Expr? ';' | 'break' ';' | 'continue' ';' | 'goto' ( ID | 'case' Expr | 'default' ) ';' | ID ':' Stmt | 'lock' (:Cond:) Stmt | 'await'? 'using' (:Res:) Stmt | 'await'? 'using' Type VarDecls ';' | 'yield' ( 'return' Expr | 'break' ) ';' | ( 'checked' | 'unchecked' | 'unsafe' ) {:Block:} | 'fixed' (:Res:) Stmt
Catch = 'catch' (:CatchPar:)? ( 'when' (:Cond:) )? {:Block:}
CatchPar = Type ID?
Finally = 'finally' {:Block:}
Res = Type VarDecls | Expr
Cond = Expr
ForCtl = ( Type VarDecls | Exprs )? ';' Expr? ';' Exprs?
Exprs = Expr ( ',' Expr )*
EachCtl = ( Type ID | Expr ) 'in' Expr
SwBody = SwItem*
SwItem = 'case' Pattern ( 'when' Expr )? ':' | 'default' ':' | Stmt
Pattern = PatOne ( ( 'and' | 'or' ) PatOne )*
PatOne = 'not' PatOne | Operand | ( '<' | '>' | BIN ) Operand | Type ID | Type? {:PatProps:} ID? | Type? (:Patterns:) ID? | 'var' ( ID | (:LParams:) ) | [:Patterns:]
PatProps = ( ID ( '.' ID )* ':' Pattern ( ',' ID ( '.' ID )* ':' Pattern )* ','? )?
Patterns = ( ( ID ':' )? Pattern ( ',' ( ID ':' )? Pattern )* )?
Expr = Operand ( InOp Operand )* ( InOp Lambda )? | Lambda | 'throw' Expr | Query
InOp = BIN | PM | '*' | '<' | '>' | '<' '<' | '>' '>' | '>' '>' '>' | '&' | '|' | '?' Expr ':' | '=' | AUG | '..'
Operand = Prefix* Postfixed ( ( 'is' Pattern ) | 'as' Type | 'switch' {:SwArms:} | 'with' {:InitItems:} )*
Prefix = PM | UN | INC | '*' | '&' | '..' | 'await' | 'ref' | (:CastT:)
CastT = Type
Postfixed = Primary Suffix* INC? | 'throw' Operand
Primary = ID TArgs? | ID '::' ID | NUM | STR | CHR | LIT | 'this' | 'base' | (:Args2:) | PRIM | 'new' New | ( 'typeof' | 'sizeof' | 'default' | 'checked' | 'unchecked' | 'nameof' ) (:TypeOrExpr:) | 'default' | 'stackalloc' Type ( [:Args:] )? {:InitItems:}? | [:Args:] | 'delegate' (:Params:)? {:Block:} | (:CastT:) Lambda
TypeOrExpr = Type | Expr
Args2 = Arg ( ',' Arg )*
New = Qual2 '?'? (:Args:) {:InitItems:}? | Qual2 {:InitItems:} | (:Args:) {:InitItems:}? | {:InitItems:} | [:Ranks:] {:InitItems:} | ( PRIM | Qual2 | (:TupleT:) ) '?'? ( [:Args:] | [:Ranks:] )+ {:InitItems:}?
Suffix = ( '.' | '?.' | '->' ) ID TArgs? | (:Args:) | '?'? [:Args:] | 'UN' | '!'
Args = ( Arg ( ',' Arg )* ','? )?
Arg = ( ID ':' )? ( ( 'ref' | 'out' | 'in' ) ( Type ID | Expr ) | Expr | Type ID )
Lambda = Attrs MOD* ( ID | Type? (:LParams:) ) '=>' ( Expr | {:Block:} )
SwArms = ( SwArm ( ',' SwArm )* ','? )?
SwArm = Pattern ( 'when' Expr )? '=>' Expr
Query = 'from' Type? ID 'in' Expr QClause* ( 'select' Expr | 'group' Expr 'by' Expr ) ( 'into' ID QClause* ( 'select' Expr | 'group' Expr 'by' Expr ) )?
QClause = 'from' Type? ID 'in' Expr | 'where' Expr | 'let' ID '=' Expr | 'join' Type? ID 'in' Expr 'on' Expr 'equals' Expr ( 'into' ID )? | 'orderby' Expr ( 'ascending' | 'descending' )? ( ',' Expr ( 'ascending' | 'descending' )? )*
"""

#: JavaScript; lines after "ts|" are TypeScript's, and "ts?" stands for what only TypeScript allows.
ECMA = """
Module = ( ModItem | Stmt )* LastStmt?
Script = ( Stmt | With )* LastStmt?
ModItem = Import | Export
Import = 'import' STR Attrib? Semi | 'import' ts?Type? ( ID | ( ID ',' )? ( '*' 'as' ID | {:ImpNames:} ) ) 'from' STR Attrib? Semi
Attrib = ( 'with' | 'assert' ) {:ObjLit:}
ImpNames = ( ImpName ( ',' ImpName )* ','? )?
ImpName = ts?Type? Name ( 'as' Name )? | STR 'as' Name
Name = ID | KW | 'default'
Export = 'export' '*' ( 'as' ( Name | STR ) )? 'from' STR Attrib? Semi | 'export' ts?Type? {:ImpNames:} ( 'from' STR Attrib? )? Semi | 'export' Decl | 'export' VarStmt Semi | 'export' 'default' ( ExportFn | Expr Semi ) | Decor+ 'export' 'default'? Decl
ExportFn = Decl | Decor* ts?Abs 'class' ClassTail | 'async'? 'function' '*'? Sig {:Block:}
Semi = ';' | NL
Block = Stmt* LastStmt?
LastStmt = ExprStmt | VarStmt | 'return' Expr? | 'throw' Expr | ( 'break' | 'continue' ) ID? | 'do' Stmt 'while' (:Cond:) | 'debugger' | LastIf | 'export' 'default' Expr | 'export' VarStmt | 'export' {:ImpNames:} ( 'from' STR )? | 'export' '*' 'from' STR | 'import' STR | 'import' ( ID | ( ID ',' )? ( '*' 'as' ID | {:ImpNames:} ) ) 'from' STR | 'for' (:ForCtl:) LastStmt | 'while' (:Cond:) LastStmt | ID ':' LastStmt
LastIf = 'if' (:Cond:) NL? ( LastStmt | Stmt NL? 'else' NL? LastStmt )
Stmt = {:Block:} | ';' | NL | Decl | VarStmt Semi | ExprStmt Semi | If | 'while' (:Cond:) NL? Stmt | 'do' Stmt 'while' (:Cond:) ';'? | 'for' 'await'? (:ForCtl:) NL? Stmt | 'switch' (:Cond:) {:SwBody:} | 'try' {:Block:} ( Catch Finally? | Finally ) | 'return' Expr? Semi | 'throw' Expr Semi | ( 'break' | 'continue' ) ID? Semi | ID ':' Stmt | 'debugger' Semi
If = 'if' (:Cond:) NL? Stmt ( NL? 'else' NL? Stmt )?
With = 'with' (:Cond:) NL? Stmt
Catch = 'catch' (:CatchPar:)? {:Block:}
CatchPar = Target TAnn
Finally = 'finally' {:Block:}
Cond = Expr
ForCtl = ( VarStmt | Expr )? ';' Expr? ';' Expr? | ( ( 'var' | 'let' | 'const' ) Target TAnn | Operand ) ( 'of' | 'in' ) Expr
SwBody = SwItem*
SwItem = ( 'case' Expr | 'default' ) ':' | Stmt | LastStmt
VarStmt = ( 'var' | 'let' | 'const' ) VarDecl ( ',' VarDecl )*
VarDecl = Target ts?Bang TAnn ( '=' Assign )?
Target = ID | {:ObjPat:} | [:ArrPat:]
ObjPat = ( ObjPatItem ( ',' ObjPatItem )* ','? )?
ObjPatItem = '...' Target | ID ( '=' Assign )? | PropName ':' Target ( '=' Assign )?
ArrPat = ( ArrPatItem? ( ',' ArrPatItem? )* )?
ArrPatItem = '...'? Target ( '=' Assign )?
Decl = 'async'? 'function' '*'? ID Sig ( {:Block:} | ts?Semi ) | Decor* ts?Abs 'class' ID ClassTail
Sig = TParams (:Params:) TAnn
TParams =
TAnn =
Params = ( Param ( ',' Param )* ','? )?
Param = Decor* ts?Access '...'? Target ts?Opt TAnn ( '=' Assign )?
Decor = '@' ID ( '.' Name )* (:Args:)? NL? | '@' (:Cond:) NL?
ClassTail = TParams ( 'extends' Postfixed ts?TArgs )? ts?Impl {:ClassBody:}
ClassBody = Member* LastMember?
Member = ';' | NL | Method | Field Semi
LastMember = Field
Method = Decor* Access ( 'async' | 'get' | 'set' )? '*'? PropName ts?Opt Sig ( {:Block:} | ts?Semi ) | 'static' {:Block:}
Field = Decor* Access PropName ts?Opt ts?Bang TAnn ( '=' Assign )?
Access = 'static'?
PropName = Name | STR | NUM | [:Elem:] | PRIVATE
Elem = Assign
ExprStmt = Expr
Expr = Assign ( ',' Assign )*
Assign = Operand ( InOp Operand )* ( InOp Arrow )? | Arrow | 'yield' '*'? Assign?
InOp = BIN | PM | '*' | '<' | '>' | '&' | '|' | '?' Assign ':' | '=' | AUG | 'in' | 'instanceof'
Operand = Prefix* Postfixed ts?As
Prefix = PM | UN | INC | 'typeof' | 'void' | 'delete' | 'await'
Postfixed = Primary Suffix* INC?
Primary = ID | NUM | STR | TPL | REGEX | JSX | LIT | 'this' | 'super' | (:Cond:) | [:ArrLit:] | {:ObjLit:} | 'async'? 'function' '*'? ID? Sig {:Block:} | Decor* 'class' ID? ClassTail | 'new' NewTail | 'import' (:Args:) | 'import' '.' ID | PRIVATE
NewTail = ( ID | 'this' | (:Cond:) | 'super' | 'new' NewTail | 'function' ID? Sig {:Block:} | 'class' ID? ClassTail ) ( '.' ( Name | PRIVATE ) | [:Cond:] )* TArgs (:Args:)? | '.' ID
TArgs =
Suffix = ( '.' | '?.' ) ( Name | PRIVATE ) | '?.'? TArgs (:Args:) | '?.'? [:Cond:] | TPL | ts?NonNull
Args = ( Arg ( ',' Arg )* ','? )?
Arg = '...'? Assign
ArrLit = ( Arg? ( ',' Arg? )* )?
ObjLit = ( ObjItem ( ',' ObjItem )* ','? )?
ObjItem = '...' Assign | ID | ID '=' Assign | PropName ':' Assign | ( 'async' | 'get' | 'set' )? '*'? PropName Sig {:Block:}
Arrow = 'async'? ( ID | TParams (:Params:) TAnn ) '=>' ( Assign | {:Block:} )
JsxExpr = ( '...' )? Expr | Empty
Empty =
ts|TParams = '<' TParam ( ',' TParam )* ','? '>'
ts|TParam = ( 'const' | 'in' | 'out' )* ID ( 'extends' Type )? ( '=' Type )?
ts|TAnn = ':' Type | ':' 'asserts'? ( ID | 'this' ) 'is' Type | ':' 'asserts' ( ID | 'this' )
ts|TArgs = '<' Type ( ',' Type )* '>'
ts|Type = Conditional | FnType | 'asserts' ID
ts|FnType = 'abstract'? 'new'? TParams (:Params:) '=>' ( Type | ID 'is' Type )
ts|Conditional = Union ( 'extends' Union '?' Type ':' Type )?
ts|Union = '|'? Inter ( '|' Inter )*
ts|Inter = '&'? TUnary ( '&' TUnary )*
ts|TUnary = ( 'keyof' | 'unique' | 'readonly' ) TUnary | 'infer' ID ( 'extends' Union )? | TPost
ts|TPost = TPrim ( [:Empty:] | [:TIndex:] )*
ts|TIndex = Type
ts|TPrim = TName TArgs | 'void' | 'typeof' TName TArgs | LIT | STR | NUM | PM NUM | TPL | 'this' | (:TParen:) | [:TTuple:] | {:TBody:} | 'import' (:Args:) ( '.' Name )* TArgs
ts|TName = ID ( '.' Name )*
ts|TParen = Type
ts|TTuple = ( TTupleItem ( ',' TTupleItem )* ','? )?
ts|TTupleItem = '...'? ( ID '?'? ':' )? Type '?'?
ts|TBody = ( TMember ( ',' | ';' | NL ) | ';' | NL )* TMember?
ts|TMember = ( PM? 'readonly' )? ( 'get' | 'set' )? PropName '?'? Sig | ( PM? 'readonly' )? PropName '?'? TAnn | ( PM? 'readonly' )? [:TKey:] ( PM? '?' )? ':' Type | TParams (:Params:) TAnn | 'new' TParams (:Params:) TAnn
ts|TKey = ID ':' Type | ID 'in' Type ( 'as' Type )?
ts|Decl = 'interface' ID TParams ( 'extends' HType ( ',' HType )* )? {:TBody:} | 'type' ID TParams '=' Type Semi | 'const'? 'enum' ID {:EnumBody:} | 'declare' ( Decl | VarStmt Semi | 'global' {:Module:} ) | ( 'namespace' | 'module' ) ( TName | STR ) ( {:Module:} | Semi ) | Decor* 'abstract' 'class' ID ClassTail
ts|LastStmt = 'type' ID TParams '=' Type | 'declare' VarStmt | 'export' 'type' ID TParams '=' Type
ts|LastStmt = 'export' 'type' {:ImpNames:} ( 'from' STR )? | 'import' 'type' ( ID | {:ImpNames:} | '*' 'as' ID ) 'from' STR | 'export' '=' Expr
ts|LastMember = Decor* Access ( 'get' | 'set' )? PropName TsOpt Sig
ts|Param = 'this' TAnn
ts|HType = TName TArgs
ts|EnumBody = ( EnumItem ( ',' EnumItem )* ','? )?
ts|EnumItem = ( Name | STR ) ( '=' Assign )?
ts|Export = 'export' '=' Expr Semi | 'export' 'as' 'namespace' ID Semi
ts|Import = 'import' 'type'? ID '=' ( 'require' (:Args:) | TName ) Semi
ts|Access = ( MOD | 'static' | 'readonly' | 'abstract' | 'declare' | 'override' )*
ts|Member = Decor* Access [:TKey:] ':' Type Semi
ts|Prefix = '<' Type '>'
ts|Type_ = 'type'
ts|Bang_ = '!'
ts|Opt_ = '?'
ts|Abs_ = 'abstract'
ts|Access_ = MOD | 'readonly' | 'override'
ts|As_ = ( ( 'as' | 'satisfies' ) ( Type | 'const' ) )+
ts|Impl_ = 'implements' HType ( ',' HType )*
ts|NonNull_ = '!'
ts|Semi_ = Semi
ts|TArgs_ = TArgs
"""

PYTHON = """
Suite = PStmt+
Unit = PStmt*
PStmt = 'Simple' | Decorated | If | While | For | Try | With | Match
Decorated = 'HDecor'* ( Def | Class )
Def = 'Def1' | 'HDef' {:Suite:}
Class = 'Class1' | 'HClass' {:Suite:}
If = ( 'If1' | 'HIf' {:Suite:} ) ( 'Elif1' | 'HElif' {:Suite:} )* Else?
Else = 'Else1' | 'HElse' {:Suite:}
While = ( 'While1' | 'HWhile' {:Suite:} ) Else?
For = ( 'For1' | 'HFor' {:Suite:} ) Else?
With = 'With1' | 'HWith' {:Suite:}
Try = ( 'Try1' | 'HTry' {:Suite:} ) ( Except+ Else? Finally? | Finally )
Except = 'Except1' | 'HExcept' {:Suite:}
Finally = 'Finally1' | 'HFinally' {:Suite:}
Match = 'HMatch' {:Cases:}
Cases = ( 'Case1' | 'HCase' {:Suite:} )+
"""

PYTHON_LINE = """
Simple = Small ( ';' Small )* ';'?
HDecor = '@' Named
HDef = 'async'? 'def' ID TParams? (:Params:) ( '->' Exprs )? ':'
Def1 = HDef Simple
HClass = 'class' ID TParams? (:Args:)? ':'
Class1 = HClass Simple
HIf = 'if' Named ':'
If1 = HIf Simple
HElif = 'elif' Named ':'
Elif1 = HElif Simple
HElse = 'else' ':'
Else1 = HElse Simple
HWhile = 'while' Named ':'
While1 = HWhile Simple
HFor = 'async'? 'for' Targets 'in' StarExprs ':'
For1 = HFor Simple
HWith = 'async'? 'with' WithItem ( ',' WithItem )* ':' | 'async'? 'with' (:WithItems:) ':'
With1 = HWith Simple
WithItems = WithItem ( ',' WithItem )* ','?
WithItem = Expr ( 'as' Target )?
HTry = 'try' ':'
Try1 = HTry Simple
HExcept = 'except' '*'? ( Expr ( 'as' ID )? | Expr ( ',' Expr )+ )? ':'
Except1 = HExcept Simple
HFinally = 'finally' ':'
Finally1 = HFinally Simple
HMatch = 'match' StarExprs ':'
HCase = 'case' Patterns ( 'if' Named )? ':'
Case1 = HCase Simple
TParams = [:TParamList:]
TParamList = TParam ( ',' TParam )* ','?
TParam = ( '*' | '**' )? ID ( ':' Expr )? ( '=' Expr )?
Small = StarExprs ( '=' AssignVal )* | Primary1 ':' Expr ( '=' AssignVal )? | Primary1 AUG AssignVal | 'pass' | 'break' | 'continue' | 'return' StarExprs? | 'raise' ( Expr ( 'from' Expr )? )? | 'global' ID ( ',' ID )* | 'nonlocal' ID ( ',' ID )* | 'del' Targets | 'assert' Expr ( ',' Expr )? | 'import' Dotted ( 'as' ID )? ( ',' Dotted ( 'as' ID )? )* | 'from' ( '.' | '...' )* Dotted? 'import' ( '*' | (:ImpNames:) | ImpName ( ',' ImpName )* ) | 'type' ID TParams? '=' Expr
ImpNames = ImpName ( ',' ImpName )* ','?
ImpName = ID ( 'as' ID )?
Dotted = ID ( '.' ID )*
AssignVal = StarExprs | Yield
Yield = 'yield' ( 'from' Expr | StarExprs )?
StarExprs = StarExpr ( ',' StarExpr )* ','? | Yield
StarExpr = '*' Operand ( BinOp Operand )* | Named
Targets = Target ( ',' Target )* ','?
Target = '*'? Primary1
Exprs = Expr ( ',' Expr )* ','?
Named = Expr | ID ':=' Expr
Expr = Logic ( 'if' Logic 'else' Expr )? | 'lambda' LParams ':' Expr
Logic = 'not'* Compare ( ( 'and' | 'or' ) 'not'* Compare )*
Compare = Arith ( CmpOp Arith )*
CmpOp = CMP | 'in' | 'not' 'in' | 'is' 'not'?
Arith = Operand ( BinOp Operand )*
BinOp = BIN | PM | '*' | '**' | '@'
Operand = ( PM | UN )* 'await'? Primary1
Primary1 = Atom Suffix*
Suffix = '.' ID | (:Args:) | [:Index:]
Atom = ID | NUM | STR+ | LIT | '...' | (:Paren:) | [:ListLit:] | {:DictLit:}
Paren = ( StarExpr ( ',' StarExpr )* ','? )? | Yield | Named Comp
Comp = ( 'async'? 'for' Targets 'in' Logic2 ( 'if' Named2 )* )+
Logic2 = Logic ( 'if' Logic 'else' Expr )?
Named2 = Logic | ID ':=' Logic | 'lambda' LParams ':' Expr
ListLit = ( StarExpr ( ',' StarExpr )* ','? )? | Named Comp
DictLit = ( DictItem ( ',' DictItem )* ','? )? | Expr ':' Expr Comp | StarExpr ( ',' StarExpr )* ','? | Named Comp
DictItem = Expr ':' Expr | '**' Operand ( BinOp Operand )*
Args = ( Arg ( ',' Arg )* ','? )? | Named Comp
Arg = Named | '*' Expr | '**' Expr | ID '=' Expr
Index = Slice ( ',' Slice )* ','?
Slice = Expr? ':' Expr? ( ':' Expr? )? | StarExpr
Params = ( Param ( ',' Param )* ','? )?
Param = ID ( ':' Expr )? ( '=' Expr )? | '*' ( ID ( ':' StarExpr )? )? | '**' ID ( ':' Expr )? | '/'
LParams = ( LParam ( ',' LParam )* ','? )?
LParam = ID ( '=' Expr )? | '*' ID? | '**' ID | '/'
Patterns = Pattern ( ',' Pattern )* ','?
Pattern = POr ( 'as' ID )? | '*' ID
POr = PAtom ( BIN PAtom )*
PAtom = Dotted (:PArgs:)? | PM? NUM ( PM NUM )? | STR+ | LIT | (:PSeq:) | [:PSeq:] | {:PMap:}
PSeq = ( Pattern ( ',' Pattern )* ','? )?
PArgs = ( PArg ( ',' PArg )* ','? )?
PArg = ( ID '=' )? Pattern
PMap = ( PMapItem ( ',' PMapItem )* ','? )?
PMapItem = ( Dotted | PM? NUM | STR+ | LIT ) ':' Pattern | '**' ID
"""


def ecma(typed: bool) -> str:
    """The grammar of JavaScript, or of TypeScript."""
    base, extra, marks = [], [], {}
    for line in ECMA.strip().split("\n"):
        if not line.startswith("ts|"):
            base.append(line)
            continue
        name = line[3:].split(" = ")[0]
        if name.endswith("_"):
            marks[name[:-1]] = line[3:].replace(name, "Ts" + name[:-1], 1) + " | "
        else:
            extra.append(line[3:])
    text = "\n".join(base)
    if not typed:
        for mark in sorted(marks, key=len, reverse=True):
            text = text.replace(f"| ts?{mark} )", ")").replace(f" | ts?{mark}\n", "\n").replace(f"ts?{mark}?", "").replace(f"ts?{mark}", "")
        return text
    for mark in sorted(marks, key=len, reverse=True):
        alone = mark in ("Semi", "NonNull")
        if alone:
            text = text.replace(f"ts?{mark}", {"Semi": "Semi", "NonNull": "'!'"}[mark])
        else:
            text = text.replace(f"ts?{mark}?", f"Ts{mark}").replace(f"ts?{mark}", f"Ts{mark}")
    marks = {k: v for k, v in marks.items() if k not in ("Semi", "NonNull")}
    return "\n".join([text, *extra, *marks.values()])


#: Nonterminals whose sentences are lists of statements or members.
LISTS = {
    "java": ("Unit", "ClassBody", "Block", "SwBody"),
    "csharp": ("Unit", "ClassBody", "Block", "SwBody"),
    "ecma": ("Module", "Script", "Block", "ClassBody", "SwBody", "TBody"),
    "python": ("Suite", "Unit", "Cases"),
}
