"""Declarations and imports as patterns over the heads of statements: a table a language, evaluated as columns.

Everything is one projection of the table of statements and an explode of names:
kinds, names, owners, visibility and qualified names are built-in functions over
``head`` and ``above``, so no rows are shuffled but the names of an import's list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import once

_MARK = r"(?:@ \w+(?: \. \w+)*(?: \( \))? )"
_ANGLES = r"< (?:[^<>]|< (?:[^<>]|< [^<>]* >)* >)* > "


def _modified(words: str, mark: str = _MARK) -> str:
    return rf"^(?:{mark}|(?:{words.replace(' ', '|')}) (?:\( \) )?)*"


_JVM = _modified("public private protected internal static final abstract sealed data override open suspend default synchronized native transient volatile strictfp inline lateinit const operator infix tailrec external enum annotation inner value expect actual vararg non -")
_JAVA = _modified("public private protected static final abstract sealed default synchronized native transient volatile strictfp")
_CS = _modified("public private protected internal static readonly sealed abstract virtual override async partial extern unsafe new volatile required ref file const event", r"\[ \] ")
_SWIFT = _modified("public private fileprivate internal open package static class final mutating nonmutating override lazy weak unowned required convenience indirect optional dynamic nonisolated async")
_TS = _modified("export default declare abstract async")
_MEMBER = _modified("public private protected static readonly abstract override declare async accessor")
_RUST = r"^(?:# (?:! )?\[ \] )*(?:pub (?:\( \) )?)?(?:default )?"
_TYPE = r"(?!return |throw |new |else |goto |using |namespace )[\w.<>\[\]?&,@*() ]*?[\w>\]?)] "
_PARTS = r"< (?:[^<>]|< [^<>]* >)*>"
_ONE = rf"[\w$]+(?: \[ \])?(?: [:?!](?:{_PARTS}|[^=,])*)?(?: = (?:{_PARTS}|[^,])*)?"
#: One or more declarators with what they begin with.
_LIST = rf"({_ONE}(?: , {_ONE})*)$"

#: Per language: kind, pattern (first group: the name or a list of declarators, second: the owner), where it stands ("top", "in", "enum" or "any").
RULES = {
    "typescript": [
        ("class", rf"{_TS}class (\w+)", "top"), ("interface", rf"{_TS}interface (\w+)", "top"), ("enum", rf"{_TS}(?:const )?enum (\w+)", "top"), ("type", rf"{_TS}type (\w+) (?:<.*> )?=", "top"),
        ("function", rf"{_TS}function (?:\* )?([\w$]+)", "top"), ("constant", rf"{_TS}const {_LIST}", "top"), ("variable", rf"{_TS}(?:let|var) {_LIST}", "top"),
        ("method", rf"{_MEMBER}(?:get |set )?(?:\* )?([\w$#]+) (?:\? )?(?:{_ANGLES})?\( \)(?: :.*?)?(?: \{{ \}})?$", "in"), ("method", rf"{_MEMBER}([\w$#]+)(?: [?!])?(?: :.*?)?(?: = .*)?$", "in"),
    ],
    "go": [
        ("method", r"^func \( \) (\w+)", "top"), ("function", r"^func (\w+)", "top"), ("interface", r"^type (\w+) (?:\[ \] )?(?:= )?interface ", "top"), ("type", r"^type (\w+) ", "top"),
        ("constant", r"^const (\w+(?: , \w+)*)", "top"), ("variable", r"^var (\w+(?: , \w+)*)", "top"),
    ],
    "rust": [
        ("method", rf"{_RUST}(?:async |unsafe |const |extern |\"\" )*fn (\w+)", "in"), ("function", rf"{_RUST}(?:async |unsafe |const |extern |\"\" )*fn (\w+)", "top"), ("type", rf"{_RUST}(?:struct|type|union) (\w+)", "top"),
        ("enum", rf"{_RUST}enum (\w+)", "top"), ("interface", rf"{_RUST}(?:unsafe |auto )*trait (\w+)", "top"), ("constant", rf"{_RUST}(?:const|static) (?:mut )?(\w+) :", "top"), ("function", rf"{_RUST}macro_rules ! (\w+)", "top"),
    ],
    "java": [
        ("type", rf"{_JAVA}@ interface (\w+)", "in"), ("class", rf"{_JAVA}(?:class|record) (\w+)", "any"), ("interface", rf"{_JAVA}(?<!@ )interface (\w+)", "any"), ("enum", rf"{_JAVA}enum (\w+)", "any"),
        ("method", rf"{_JAVA}(?:{_ANGLES})?(?:{_TYPE})?(\w+) \( \)(?: \[ \])*(?: throws [\w., ]+?)?(?: default .*)?(?: \{{ \}})?$", "member"), ("constant", rf"^{_MARK}*(\w+)(?: \( \))?(?: \{{ \}})?$", "enum"),
        ("variable", rf"{_JAVA}{_TYPE}{_LIST}", "in"),
    ],
    "kotlin": [
        ("interface", rf"{_JVM}(?:fun )?interface (\w+)", "any"), ("class", rf"{_JVM}companion object ?(\w*)", "in"), ("class", rf"{_JVM}(?:class|object) (\w+)", "any"), ("type", rf"{_JVM}typealias (\w+)", "any"),
        ("method", rf"{_JVM}fun (?:{_ANGLES})?(?:(?:[\w.]+ \. )?\w+ (?:{_ANGLES})?(?:\? )?)\. (\w+) \( \)", "top"), ("method", rf"{_JVM}fun (?:{_ANGLES})?(?:[\w.<>, ?]+ \. )?(\w+) \( \)", "in"), ("function", rf"{_JVM}fun (?:{_ANGLES})?(\w+) \( \)", "top"),
        ("variable", rf"{_JVM}va[lr] (?:{_ANGLES})?(?:[\w.<>?]+ \. )?(\w+)", "any"),
    ],
    "csharp": [
        ("type", rf"{_CS}delegate .+? (\w+) (?:{_ANGLES})?\( \)", "any"), ("class", rf"{_CS}(?:class |record (?:class )?(?!struct ))(\w+)", "any"), ("interface", rf"{_CS}interface (\w+)", "any"),
        ("type", rf"{_CS}(?:record )?struct (\w+)", "any"), ("enum", rf"{_CS}enum (\w+)", "any"), ("constant", r"^(?:\[ \] )*(\w+)(?: = .*)?$", "enum"),
        ("method", rf"{_CS}(?:{_TYPE})?(\w+) (?:{_ANGLES})?\( \)(?: : (?:this|base) \( \))?(?: where .*?)?(?: \{{ \}}| => .*)?$", "in"),
        ("variable", rf"{_CS}{_TYPE}(\w+) (?:\{{ \}}(?: = .*)?|=> .*)$", "in"), ("variable", rf"{_CS}{_TYPE}{_LIST}", "in"),
    ],
    "swift": [
        ("interface", rf"{_SWIFT}protocol (\w+)", "any"), ("class", rf"{_SWIFT}(?:class|actor) (?!func |var |let |subscript )(\w+)", "any"), ("type", rf"{_SWIFT}struct (\w+)", "any"), ("enum", rf"{_SWIFT}enum (\w+)", "any"), ("type", rf"{_SWIFT}typealias (\w+)", "any"),
        ("method", rf"{_SWIFT}func (\w+)", "in"), ("function", rf"{_SWIFT}func (\w+)", "top"), ("method", rf"{_SWIFT}(init)(?: [?!])?(?: <.*>)? \( \)", "in"), ("method", rf"{_SWIFT}(subscript)\b", "in"),
        ("constant", rf"{_SWIFT}case (\w+(?: \( \))?(?: = [^,]*)?(?: , \w+(?: \( \))?(?: = [^,]*)?)*)$", "in"), ("variable", rf"{_SWIFT}(?:var|let) (\w+)", "any"),
    ],
}
RULES["javascript"] = RULES["typescript"]
#: Heads above a member that lend it their name, and those that are only a prefix.
_HOLDERS = {
    "typescript": r"(?:^| )class (\w+)", "rust": r"(?:^| )trait (\w+)|(?:^| )impl (?:< (?:[^<>]|< [^<>]* >)* > )?(?:.* for )?(\w[^{]*?) (?:where .*)?\{", "java": r"(?:^| )(?:class|interface|enum|record) (\w+)",
    "kotlin": r"(?:^| )(?:class|interface|object) (\w+)|companion object( )\{", "csharp": r"(?:^| )(?:class|struct|interface|enum|record) (?!struct |class )(\w+)|(?:^| )namespace ([\w. ]+?)(?: \{|$)", "swift": r"(?:^| )(?:class|struct|enum|protocol|extension|actor) (?!func )(\w+(?: \. \w+)*)",
}
_HOLDERS |= {"javascript": _HOLDERS["typescript"], "go": "(?!)"}
#: Heads that are a place for "enum" rules.
_ENUM = r"(?:^| )enum (?:class )?\w"


def _holder(language: str, head: Column) -> Column:
    """The name a head lends to what stands in it; empty where it has none."""
    groups = re.compile(_HOLDERS[language]).groups
    found = F.concat_ws("", *[F.regexp_extract(head, _HOLDERS[language], i) for i in range(1, groups + 1)]) if groups else F.lit("")
    if language == "kotlin":
        found = F.when(found == " ", "Companion").otherwise(found)
    return F.regexp_replace(found, " ", "")


def _visible(language: str, head: Column, name: Column, above: Column) -> Column:
    """public, internal or private."""
    before = F.regexp_extract(head, r"^(.*?)(?: \( \)(?! (?:var|let|func|static|class|struct|fn))| \{ \}|$)", 1)
    word = lambda *ws: before.rlike(rf"(?:^| )(?:{'|'.join(ws)})(?: |$)")
    inside = above != ""
    if language in ("typescript", "javascript"):
        return F.when(word("export") | inside, "public").otherwise("private")
    if language == "go":
        return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")
    if language == "rust":
        own = F.when(head.rlike(r"^(?:# (?:! )?\[ \] )*pub \( \)"), "internal").when(head.rlike(r"^(?:# (?:! )?\[ \] )*pub |macro_rules !"), "public").otherwise("private")
        return F.when(above.rlike(r"(?:^| )trait ") & ~head.contains("{"), "public").otherwise(own)
    listed = F.when(word("private protected"), "private").when(word("private", "fileprivate"), "private").when(word("protected", "internal", "package"), "internal").when(word("public", "open"), "public")
    if language == "swift":
        listed = F.when(head.rlike(r"(?:^| )(?:public|open) (?!\( \))"), "public").otherwise(listed)
    member = above.rlike(r"(?:^| )(?:interface|protocol|enum) ") & (F.lit(language != "kotlin"))
    default = {"java": "internal", "kotlin": "public", "csharp": None, "swift": "internal"}[language]
    if default is None:
        return F.coalesce(listed, F.when(member, "public").when(above.rlike(r"(?:^| )(?:class|struct|record) "), "private").otherwise("internal"))
    if language == "swift":
        member = above.rlike(r"(?:^| )protocol ") | (head.rlike("^(?:indirect )?case ") & above.rlike(r"(?:^| )public "))
    if language == "java":
        member = above.rlike(r"(?:^| )interface ") | (above.rlike(_ENUM) & head.rlike(rf"^{_MARK}*\w+(?: \( \))?(?: \{{ \}})?$") & (name != F.col("holder")))
    return F.coalesce(listed, F.when(member, "public").otherwise(default))


def _found(language: str) -> Column:
    """What a statement declares: kind and the text of its names; null if nothing."""
    head, near = F.col("head"), F.col("near")
    place = {"top": near == "", "in": near != "", "member": near != "", "any": F.lit(True), "enum": near.rlike(_ENUM)}
    if language == "csharp":
        held = ~near.rlike("^namespace ") & (near != "")
        place |= {"top": ~held, "in": held}
    if language == "java":  # a word and brackets in an enum is a constant, unless it is the enum's name
        place["member"] = (near != "") & ~(near.rlike(_ENUM) & head.rlike(rf"^{_MARK}*\w+ \( \)(?: \{{ \}})?$") & (F.regexp_extract(head, r"(\w+) \( \)", 1) != F.col("holder")))
        place["enum"] = place["enum"] & (F.regexp_extract(head, rf"^{_MARK}*(\w+)", 1) != F.col("holder"))
    if language == "csharp":
        place["in"] = place["in"] & ~near.rlike(_ENUM)
    return F.coalesce(*[F.when(place[where] & head.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(head, pattern, 1).alias("names"))) for kind, pattern, where in RULES[language]])


def _case(languages, of) -> Column:
    out = None
    for x in languages:
        out = F.when(F.col("language") == x, of(x)) if out is None else out.when(F.col("language") == x, of(x))
    return out


def symbols(statements: DataFrame) -> DataFrame:
    """The declarations among the statements, in the columns of symbols."""
    languages = list(RULES)
    rows = statements.where(~F.col("head").rlike("^(?:import|use|name|require|using|package) "))
    keep = ["file_path", "language", "head", "group", "signature", "start_line", "end_line"]
    near = F.coalesce(F.get("above", F.size("above") - 1), F.lit(""))
    rows = once(rows, keep, {"near": near, "holders": F.filter(_case(languages, lambda x: F.transform("above", lambda h: _holder(x, h))), lambda x: x != "")})
    rows = rows.withColumn("holder", F.coalesce(F.get("holders", F.size("holders") - 1), F.lit("")))
    rows = once(rows, [*keep, "near", "holders", "holder"], {"found": _case(languages, _found)}).where("found IS NOT NULL")
    kind, head = F.col("found.kind"), F.col("head")
    plain = F.regexp_replace("found.names", _PARTS, "")  # commas between types part no names
    names = F.filter(F.regexp_extract_all(plain, F.lit(r"(?:^| , )([\w$#]+)"), 1), lambda x: x != "_")
    names = F.when((F.col("language") == "kotlin") & head.rlike("companion object") & (F.col("found.names") == ""), F.array(F.lit("Companion"))).otherwise(names)
    rows = rows.select("*", F.explode(names).alias("name"))
    fixed = F.when((F.col("language") == "java") & head.rlike(r"^[^=(]*\bstatic\b[^=(]*\bfinal\b|^[^=(]*\bfinal\b[^=(]*\bstatic\b"), True).when((F.col("language") == "csharp") & head.rlike(r"^[^=(]*\bconst\b|^[^=(]*\bstatic readonly\b|^[^=(]*\breadonly static\b"), True).otherwise(False)
    kind = F.when((kind == "variable") & fixed & ~head.rlike(r"\{ \}"), "constant").when((kind == "type") & (F.col("language") == "swift") & head.rlike("@ main "), "class").otherwise(kind)
    # the owner a declaration names itself: a Go receiver, the type a Kotlin function extends
    receiver = F.regexp_extract("group", r"(\w+)\s*(?:\[[^\]]*\])?\s*$", 1)
    extended = F.regexp_extract(head, rf"fun (?:{_ANGLES})?(?:[\w.]+ \. )?(\w+) (?:{_ANGLES})?(?:\? )?\. \w+ \( \)", 1)
    named = F.when((F.col("language") == "go") & (kind == "method"), receiver).when((F.col("language") == "kotlin") & (kind == "method") & (extended != ""), extended)
    around = F.when(F.col("holder") != "", F.array_join("holders", "."))
    only_prefix = F.col("near").rlike("^namespace ")
    parent = F.coalesce(named, F.when(~only_prefix, around))
    prefix = F.coalesce(named, around)
    qualified = F.when((F.col("language") == "rust") & (kind == "method") & (~F.col("near").rlike("(?:^| )trait ") | head.contains("{")), F.concat(F.lit("impl_"), prefix, F.lit("::"), "name")).otherwise(F.concat_ws(".", prefix, "name"))
    visible = _case(languages, lambda x: _visible(x, head, F.col("name"), F.col("near")))
    marks = F.regexp_extract_all("signature", F.lit(r"@([\w.]+)"), 1)
    return rows.select("file_path", "name", qualified.alias("qualified_name"), kind.alias("kind"), "start_line", "end_line", visible.alias("visibility"), "signature", F.lit(None).cast("string").alias("docstring"), marks.alias("decorators"), parent.alias("parent"))


def imports(statements: DataFrame) -> DataFrame:
    """The imports among the statements, in the columns of imports; names of a list come together by their statement."""
    head, lang = F.col("head"), F.col("language")
    quoted = F.regexp_replace(F.element_at("texts", -1), r"^['\"`]|['\"`]$", "")
    script, listed = lang.isin("typescript", "javascript"), F.array().cast("array<string>")
    pairs = statements.where(head.rlike("^name ") & (lang != "rust")).select("file_path", "root", "n", F.regexp_replace(head, "^name (?:type )?", "").alias("said"))
    held = pairs.groupBy("file_path", F.col("root").alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", F.regexp_extract("said", r"^(\S+)", 1).alias("name"), F.regexp_extract("said", r" as (\S+)$", 1).alias("alias")))).alias("list"))
    first = lambda c: F.when(c != "", c)
    rows = statements.where(script & ((head.rlike(r"^import\b") & (F.size("texts") > 0)) | head.rlike(r'^export .*from ""') | head.rlike('^require ""'))).join(held, ["file_path", "n"], "left")
    default = first(F.regexp_extract("head", r"^import (?:type (?!from ))?([\w$]+)(?: ,| from)", 1))
    star = F.col("head").rlike(r"^(?:import|export) .*\*")
    inner = F.coalesce(F.transform("list", lambda x: x["name"]), listed)
    names = F.when(star, F.array(F.lit("*"))).otherwise(F.concat(F.when(default.isNotNull(), F.array(default)).otherwise(listed), inner))
    alias = F.coalesce(first(F.regexp_extract("head", r"\* as ([\w$]+)", 1)), F.get(F.filter(F.transform("list", lambda x: x["alias"]), lambda x: x != ""), F.lit(0)))
    out = rows.select("file_path", quoted.alias("module"), names.alias("names"), alias.alias("alias"), F.col("start_line").alias("line"), quoted.startswith(".").alias("is_relative"))
    # Rust: a row a module and statement, whose names are the last parts of its paths
    path = F.regexp_replace(F.regexp_replace("head", r"^.*?\buse (?::: )?", ""), " ", "\u0001")
    leaf = statements.where((lang == "rust") & head.rlike(r"^(?:# (?:! )?\[ \] )*(?:pub (?:\( \) )?)?use ") & ~head.rlike(r"\{"))
    leaf = leaf.select("file_path", "root", "n", F.split(F.regexp_extract(path, "^(.*?)(?:\u0001as\u0001.*)?$", 1), "\u0001::\u0001").alias("parts"), first(F.regexp_extract("head", r" as (\w+)$", 1)).alias("alias"), "start_line")
    several = F.size("parts") > 1
    leaf = leaf.select("file_path", "root", "n", F.when(several, F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "::")).otherwise(F.get("parts", F.lit(0))).alias("module"), F.when(several, F.element_at("parts", -1)).alias("name"), "alias", "start_line")
    joined = leaf.groupBy("file_path", "root", "module").agg(F.array_sort(F.collect_list(F.struct("n", "name", "alias"))).alias("list"), F.min("start_line").alias("line"))
    joined = joined.select("file_path", "module", F.array_compact(F.transform("list", lambda x: x["name"])).alias("names"), F.when(F.size("list") == 1, F.get("list", F.lit(0))["alias"]).alias("alias"), "line", F.col("module").rlike("^(?:crate|self|super)(?:::|$)").alias("is_relative"))
    out = out.unionByName(joined)
    # one line, one module
    rest = {
        "go": (r"^import (?:([\w.]+) )?\"\"", quoted, first(F.regexp_extract("head", r"^import (\w+) \"\"", 1))),
        "java": (r"^import ", F.regexp_replace(F.regexp_extract("head", r"^import (?:static )?(.*)$", 1), " ", ""), None),
        "kotlin": (r"^import ", F.regexp_replace(F.regexp_extract("head", r"^import (.*?)(?: as .*)?$", 1), " ", ""), first(F.regexp_extract("head", r" as (\w+)$", 1))),
        "csharp": (r"^(?:global )?using (?!\( )(?!var )[\w. =<>]+$", F.regexp_replace(F.regexp_extract("head", r"using (?:static )?(?:\w+ = )?(.*)$", 1), " ", ""), first(F.regexp_extract("head", r"using (\w+) =", 1))),
        "swift": (r"^(?:@ \w+ )*import ", F.regexp_replace(F.regexp_extract("head", r"import (?:(?:class|struct|enum|protocol|func|var|let|typealias) )?(.*)$", 1), " ", ""), None),
    }
    none = F.lit(None).cast("string")
    for language, (pattern, module, alias) in rest.items():
        rows = statements.where((lang == language) & (F.size("above") == 0) & head.rlike(pattern))
        names, whole = listed, module
        if language == "java":  # a static import names a member of its module
            fixed = F.col("head").startswith("import static ")
            names = F.when(fixed, F.array(F.regexp_extract(module, r"(\w+|\*)$", 1))).otherwise(listed)
            whole = F.when(fixed, F.regexp_replace(module, r"\.(\w+|\*)$", "")).otherwise(module)
        if language == "go":
            alias = F.when(alias != "_", alias)
        out = out.unionByName(rows.select("file_path", whole.alias("module"), names.alias("names"), (none if alias is None else alias).alias("alias"), F.col("start_line").alias("line"), F.lit(False).alias("is_relative")))
    return out
