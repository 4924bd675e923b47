"""Names, labels and instruction text, as column expressions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the normalised instruction vocabulary knows.
PREFIXES = ("bnd", "lock", "rep", "repe", "repne", "repnz", "repz")
FLOW_TYPES = ("call", "ccall", "cjmp", "jmp", "rcall", "rjmp", "ucall", "ujmp")
FLOW_MNEMONICS = ("call", "callf", "jmp", "jmpf", "loop", "loope", "loopne", "loopnz", "loopz", "xbegin")
SIZE_WORDS = ("byte", "dword", "far", "fs", "gs", "near", "oword", "qword", "tword", "word", "xmmword", "ymmword", "zmmword")
REGISTER = (
    r"^(?:"
    r"(?:r(?:1[0-5]|[8-9])(?:b|d|w)?)|"
    r"(?:[re]?(?:ax|bx|cx|dx|si|di|bp|sp|ip))|"
    r"(?:[abcd][hl])|"
    r"(?:[sd]il|[bs]pl)|"
    r"(?:[cdefgs]s)|"
    r"(?:[xyz]mm(?:[12]?[0-9]|3[01]))|"
    r"(?:mm[0-7])|(?:st(?:\([0-7]\)|[0-7]))|"
    r"(?:k[0-7])|(?:bnd[0-3])|"
    r"(?:cr(?:[0-9]|1[0-5]))|(?:dr(?:[0-9]|1[0-5]))|"
    r"(?:rflags|eflags|flags|mxcsr|eiz|riz)"
    r")$"
)
# the character before a symbol is captured, as neither engine need look behind
SYMBOL = r"(^|[^0-9a-z_])(sym(\.imp)?|fcn|loc|obj|str|reloc|section|segment)\.[^\s,\[\]+*():]+"
RIP_MEMORY = r"\[[^\]]*\b(rip|eip)\b[^\]]*\]"
SEGMENT = r"\b(cs|ds|es|ss)\s*:"
FAMILY_PATTERNS = (("libc.a", "glibc"), ("libpcre2-8.a", "pcre2"), ("libpcre2-posix.a", "pcre2-posix"), ("libiconv.a", "iconv"), ("libcharset.a", "charset"), ("libgcc_eh.a", "libgcc_eh"), ("libgcc.a", "libgcc"))
CU_PREFIXES = ("libpcre2_8_la-", "libpcre2_posix_la-")


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def normalize_legacy(text: Column) -> Column:
    """Commas to blanks, runs of blanks to one, outer blanks off."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ",", " "), "  +", " "))


def _operand_token(t: Column, references: Column | None) -> Column:
    bare = F.regexp_replace(t, "^%+", "")
    digits = F.coalesce(F.nullif(F.ltrim(F.substring(t, 3, 64), F.lit("0")), F.lit("")), F.lit("0"))
    decimal = t.try_cast("bigint")
    # as decimal text, since 16 hex digits may exceed a BIGINT
    whole = F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))
    value = F.when(t.rlike("^0x[0-9a-f]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10)).when(t.rlike("^[0-9]+$"), whole)
    known = F.coalesce(F.array_contains(F.transform(references, lambda x: x.cast("string")), value), F.lit(False)) if references is not None else F.lit(False)
    hexed = F.when(t.rlike("^0x[0-9a-f]+$"), F.concat(F.lit("0x"), digits)).when(t.rlike("^[0-9]+$") & decimal.isNotNull(), F.concat(F.lit("0x"), F.lower(F.hex(decimal))))
    return (
        F.when(_in(t, ("[", "]", "+", "-", "*", ":", "address")), t)
        .when(hexed.isNotNull(), F.when(known, "address").otherwise(hexed))
        .when(bare.rlike(REGISTER) | _in(bare, SIZE_WORDS), bare)
        .when(t.contains(".") | t.contains("@") | t.rlike("^[a-z_$?][0-9a-z_$?]*$"), "address")
        .otherwise(t)
    )


def normalize_v2(text: Column, instruction_type: Column | None = None, references: Column | None = None) -> Column:
    """Instruction text without symbol identities: one blank between tokens.

    ``references`` is an array of addresses that stand for ``address``. Null gives null, blank text an
    empty string. Decimals beyond 64 bits stay as they are.
    """
    t = F.trim(F.regexp_replace(F.lower(F.split_part(text, F.lit(";"), F.lit(1))), "[\\t\\n\\x0b\\x0c\\r ]+", " "))
    first, rest = F.split_part(t, F.lit(" "), F.lit(1)), F.regexp_replace(t, "^[^ ]* ?", "")
    prefixed = _in(first, PREFIXES) & (rest != "")
    word = F.when(prefixed, F.split_part(rest, F.lit(" "), F.lit(1))).otherwise(first)
    operand = F.when(prefixed, F.regexp_replace(rest, "^[^ ]* ?", "")).otherwise(rest)
    mnemonic = F.when(word == "movabs", "mov").otherwise(word)
    flow = _in(mnemonic, FLOW_MNEMONICS) | (mnemonic.startswith("j") & (F.length(mnemonic) > 1))
    if instruction_type is not None:
        flow = flow | F.coalesce(_in(F.lower(instruction_type), FLOW_TYPES), F.lit(False))
    indirect = operand.contains("[") | operand.contains("(") | F.regexp_replace(F.split_part(operand, F.lit(" "), F.lit(1)), "^%+", "").rlike(REGISTER)
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(operand, RIP_MEMORY, "[ address ]"), SYMBOL, "$1address"), SEGMENT, "")
    operand = F.when((operand != "") & flow & ~indirect, F.lit("address")).otherwise(shown)
    padded = F.regexp_replace(F.regexp_replace(operand, ",", " "), r"([\[\]+\-*:])", " $1 ")
    words = F.filter(F.split(padded, "[\\t\\n\\x0b\\x0c\\r ]+"), lambda x: (x != "") & (x != "ptr"))
    tokens = F.transform(words, lambda x: _operand_token(x, references))
    head = F.when(prefixed, F.concat(first, F.lit(" "), mnemonic)).otherwise(mnemonic)
    return F.when(t == "", F.lit("")).otherwise(F.concat_ws(" ", F.array(head), tokens))


def normalize_instruction(text: Column, mode: str = "v2", **kw) -> Column:
    """``legacy`` or ``v2``; any other mode is an error."""
    if mode not in ("legacy", "v2"):
        raise ValueError(f"unknown mode {mode!r}: legacy or v2")
    return normalize_legacy(text) if mode == "legacy" else normalize_v2(text, **kw)


def normalize_record(disasm: Column, opcode: Column, mode: str = "v2", instruction_type: Column | None = None, jump: Column | None = None, pointer: Column | None = None) -> Column:
    """The instruction of a disassembler's record: its ``disasm`` text or, if that is null or empty, its ``opcode``; its own jump and pointer are references."""
    text = F.coalesce(F.nullif(disasm, F.lit("")), opcode, F.lit(""))
    if mode != "v2":
        return normalize_instruction(text, mode)
    refs = [x.cast("bigint") for x in (jump, pointer) if x is not None]
    references = F.filter(F.array(*refs), lambda x: x.isNotNull() & (x >= 0)) if refs else None
    return normalize_v2(text, instruction_type, references)


def canonical_symbol(name: Column) -> Column:
    """One leading ``sym.imp.``, ``sym.`` or ``reloc.`` off, and what follows ``@``."""
    return F.split_part(F.regexp_replace(name, r"^(sym\.imp\.|sym\.|reloc\.)", ""), F.lit("@"), F.lit(1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def archive_family(name: Column) -> Column:
    """The archive's stem: basename in lower case, cut after ``.a`` where a digest follows, then without ``.a``."""
    low = F.lower(basename(name))
    cut = F.when(low.contains(".a."), F.concat(F.substring_index(low, ".a.", 1), F.lit(".a"))).otherwise(low)
    return F.regexp_replace(cut, r"\.a$", "")


def pattern_family(name: Column) -> Column:
    """The family by fixed patterns, else the leading ``lib...`` up to the first dot, else the name."""
    low = F.lower(basename(name))
    out = F.when(low.rlike(r"^lib[^.]+"), F.regexp_extract(low, r"^(lib[^.]+)", 1)).otherwise(low)
    for archive, family in reversed(FAMILY_PATTERNS):
        out = F.when((low == archive) | low.startswith(archive + "."), family).otherwise(out)
    return out


def cu_name(name: Column) -> Column:
    """Basename without ``.o``, then without ``.c``, then without one known prefix."""
    base = F.regexp_replace(F.regexp_replace(basename(name), r"\.o$", ""), r"\.c$", "")
    return F.regexp_replace(base, "^(" + "|".join(CU_PREFIXES) + ")", "")


def stem(name: Column) -> Column:
    """Basename without one source or object suffix, without repeated libtool prefixes, lower case, ``-`` as ``_``."""
    base = F.regexp_replace(basename(name), r"\.(o|lo|obj|c|cc|cpp|cxx|s|S|asm)$", "")
    return F.translate(F.lower(F.regexp_replace(base, r"^(lib[A-Za-z0-9_]+_la-)+", "")), "-", "_")


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_")


def version_order(source: Column) -> Column:
    """The numbers of the first ``-1.2.3`` in a name, as an array that sorts by version; empty without one."""
    digits = F.regexp_extract(source, r"-([0-9][0-9.]*)", 1)
    return F.transform(F.filter(F.split(digits, r"\."), lambda x: x != ""), lambda x: x.cast("bigint"))


def stable_label(name: Column, identity: Column, count: Column) -> Column:
    """``name``, with 16 hex digits of the identity's digest where the name is not unique."""
    return F.when(count == 1, name).otherwise(F.concat(name, F.lit("."), F.substring(F.sha2(identity, 256), 1, 16)))


def stable_rank_key(*parts: Column) -> Column:
    """A digest to rank rows by, the same on every run."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def digest_index(digest: Column, n: Column) -> Column:
    """The first 64 bits of a hex digest, unsigned, modulo ``n``."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("bigint")


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def finite_ratio(value: Column) -> Column:
    """Is it a finite number from 0 to 1?"""
    return F.coalesce(~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))


def path_coordinates(path: Column) -> dict[str, Column]:
    """``toolchain, optimization, archive`` from the last three parts of a path; null for shorter paths."""
    parts = F.split(path, "/")
    at = lambda i: F.nullif(F.get(parts, F.size(parts) - i), F.lit(""))
    deep = F.size(parts) >= 3
    return {n: F.when(deep, at(i)) for n, i in (("toolchain", 3), ("optimization", 2), ("archive", 1))}


def path_label(path: Column) -> Column:
    """A name for a path that is safe in file names: its parts joined by ``__``."""
    return safe_name(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+", "__"))


def source_build(value: Column) -> Column:
    """The spelling of a source folder: basename in lower case, the first ``-v`` before the version as ``-``."""
    low = F.lower(basename(value))
    at = F.instr(low, "-v")
    return F.when(at > 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def render_identity(*parts: Column) -> Column:
    """``a|b|c``; null parts are empty."""
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


def parse_identity(value: Column, names: list[str]) -> Column:
    """The parts of ``a|b|c`` as a struct; what follows the last bar that is needed belongs to the last part."""
    parts = F.split(value, r"\|", len(names))
    return F.struct(*(F.get(parts, i).alias(n) for i, n in enumerate(names)))


def iso_time(value: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS``."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def clock(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; hours may exceed a day."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
