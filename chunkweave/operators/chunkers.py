"""Structural chunkers: sections to blocks, blocks to packed chunks, per file extension.

A chunker is a function of ``(path, content, options)`` giving a ``SECTIONED`` struct: the sections
of the document and how to cut and name them. Cutting and packing are one shared expression, so a
plan that routes over many chunkers holds it once. All of it stays inside the row of the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.arrays import first_of_each
from chunkweave.functions.text import is_blank, let, split_lines, word_count
from chunkweave.operators.packing import ChunkingOptions, TokenCounter, micro_split, pack_blocks, paragraphs
from chunkweave.operators.segments import CODE_LEAD, brace_sections, code_segments, file_header, heading_sections, is_header_line

BLOCK_META = (
    "struct<kind:string,level:string,parent_id:string,child_index:int,symbol:string,"
    "line_start:int,line_end:int,hard_split:boolean>"
)
CHUNK = (
    "struct<id:string,text:string,chunker:string,lang:string,ext:string,preamble:boolean,"
    f"block_count:int,blocks_meta:array<{BLOCK_META}>>"
)
CHUNKS = f"array<{CHUNK}>"
SECTION = "struct<text:string,parent_id:string,symbol:string,start_line:int,end_line:int>"
SECTIONED = (
    f"struct<sections:array<{SECTION}>,split:string,parent_kind:string,child_kind:string,"
    "chunker:string,prefix:string,lang:string,header:string,separator:string>"
)

# Extensions by chunker.
CODE_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".html", ".css", ".scss", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs",
    ".php", ".rb", ".kt", ".swift", ".json", ".yaml", ".yml", ".xml",
)

Chunker = Callable[[Column, Column, ChunkingOptions], Column]


def pick_chunker(ext: Column) -> Column:
    """Name of the chunker for an extension."""
    e = F.lower(ext)
    return (
        F.when(e == ".java", F.lit("java"))
        .when(e == ".py", F.lit("python"))
        .when(e == ".md", F.lit("markdown"))
        .when(e.isin(".txt", ".rst"), F.lit("text"))
        .when(e.isin(*CODE_EXTENSIONS), F.lit("code"))
        .otherwise(F.lit("text"))
    )


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _sectioned(
    sections: Column, *, split: str, kinds: tuple[str, str], chunker: str, prefix: str | None = None, lang: str | None = None, header: Column | None = None, separator: str = "\n\n"
) -> Column:
    """What one chunker makes of a document: its sections and how they are to be cut and named."""
    return F.struct(
        sections.alias("sections"),
        F.lit(split).alias("split"),
        F.lit(kinds[0]).alias("parent_kind"),
        F.lit(kinds[1]).alias("child_kind"),
        F.lit(chunker).alias("chunker"),
        F.lit(prefix or chunker).alias("prefix"),
        F.lit(lang).cast("string").alias("lang"),
        (F.lit("") if header is None else header).alias("header"),
        F.lit(separator).alias("separator"),
    ).cast(SECTIONED)


def _section(text: Column, parent_id: Column, symbol=None, first=None, last=None) -> Column:
    return F.struct(
        text.alias("text"),
        parent_id.alias("parent_id"),
        (_null("string") if symbol is None else symbol).alias("symbol"),
        (_null("int") if first is None else first).alias("start_line"),
        (_null("int") if last is None else last).alias("end_line"),
    )


def text_chunker(path: Column, content: Column, options: ChunkingOptions) -> Column:
    sections = F.transform(
        paragraphs(content), lambda t, i: _section(t, F.concat_ws(":", path, F.lit("text:para"), i))
    )
    return _sectioned(sections, split="paragraphs", kinds=("paragraph", "paragraph_child"), chunker="text")


def markdown_chunker(path: Column, content: Column, options: ChunkingOptions) -> Column:
    def section(s: Column, i: Column) -> Column:
        title = F.substring(F.when(s["title"] == "", F.lit("untitled")).otherwise(s["title"]), 1, 64)
        return _section(s["text"], F.concat_ws(":", path, F.lit("md:section"), i, title), symbol=s["title"])

    return _sectioned(
        F.transform(heading_sections(content), section),
        split="paragraphs",
        kinds=("md_section", "md_child"),
        chunker="markdown",
        lang="markdown",
    )


def brace_chunker(path: Column, content: Column, options: ChunkingOptions) -> Column:
    sections = F.transform(
        brace_sections(content), lambda t, i: _section(t, F.concat_ws(":", path, F.lit("brace:part"), i))
    )
    return _sectioned(sections, split="lines", kinds=("brace_part", "brace_child"), chunker="brace")


def line_chunker(path: Column, content: Column, options: ChunkingOptions) -> Column:
    """Every non-blank line is a block: the fallback where no structure is known."""
    lines = F.filter(split_lines(content), lambda line: ~is_blank(line))
    sections = F.transform(lines, lambda line: _section(line, _null("string")))
    return _sectioned(sections, split="none", kinds=("line", "line"), chunker="code:fallback", prefix="code_fallback")


def symbol_chunker(language: str, separator: str = "\n\n") -> Chunker:
    """Definitions as symbols, with a preamble chunk and the header repeated before children.

    Segments come from line patterns. Lines above the first definition are a section of their own, unless the
    preamble holds all of them. Files without any definition fall back to line blocks.
    """

    def chunker(path: Column, content: Column, options: ChunkingOptions) -> Column:
        def section(s: Column) -> Column:
            lines = F.concat_ws("-", s["start_line"], s["end_line"])
            symbol = F.coalesce(s["symbol"], F.lit("anon"))
            parent = F.concat_ws(":", path, F.lit(language), s["kind"], symbol, lines)
            return _section(s["text"], parent, s["symbol"], s["start_line"], s["end_line"])

        def told(s: Column) -> Column:
            """Whether the preamble says all that the lead does."""
            short = (s["kind"] == CODE_LEAD) & (F.length(s["text"]) <= options.max_header_chars)
            return short & F.forall(split_lines(s["text"]), lambda line: is_blank(line) | is_header_line(line))

        def build(segments: Column) -> Column:
            shown = F.filter(segments, lambda s: ~told(s)) if options.include_source_preamble else segments
            symbols = _sectioned(
                F.transform(shown, section),
                split=options.micro_split_strategy,
                kinds=("symbol", "symbol_child"),
                chunker=language,
                lang=language,
                header=file_header(content, options.max_header_chars) if options.include_source_preamble else None,
                separator=separator,
            )
            known = F.coalesce(F.get(segments, F.lit(0))["kind"], F.lit("")).isin("code_symbol", CODE_LEAD)
            return F.when(known, symbols).otherwise(line_chunker(path, content, options))

        return let(code_segments(path, content), build)

    return chunker


CHUNKERS: dict[str, Chunker] = {
    "java": symbol_chunker("java", "\n\n// ... code ...\n\n"),
    "python": symbol_chunker("python"),
    "code": symbol_chunker("code"),
    "markdown": markdown_chunker,
    "text": text_chunker,
    "brace": brace_chunker,
    "lines": line_chunker,
}


def register_chunker(name: str, chunker: Chunker) -> None:
    CHUNKERS[name.strip()] = chunker


def routed(path: Column, ext: Column, content: Column, options: ChunkingOptions) -> Column:
    """The sections by the chunker of the file's extension, picked per row in one pass."""
    name = pick_chunker(ext)
    return (
        F.when(name == "java", CHUNKERS["java"](path, content, options))
        .when(name == "python", CHUNKERS["python"](path, content, options))
        .when(name == "markdown", CHUNKERS["markdown"](path, content, options))
        .when(name == "code", CHUNKERS["code"](path, content, options))
        .otherwise(CHUNKERS["text"](path, content, options))
    )


def parent_child_blocks(plan: Column, options: ChunkingOptions, count: TokenCounter = word_count) -> Column:
    """Sections to blocks: micro parts as children, and the section itself if parents are wanted."""

    def block(text: Column, kind: Column, level: str, section: Column, index: Column) -> Column:
        return F.struct(
            text.alias("text"),
            kind.alias("kind"),
            F.lit(level).alias("level"),
            section["parent_id"].alias("parent_id"),
            index.cast("int").alias("child_index"),
            section["symbol"].alias("symbol"),
            section["start_line"].alias("line_start"),
            section["end_line"].alias("line_end"),
        )

    def expand(section: Column) -> Column:
        whole = F.array(section["text"])
        if options.hierarchical:
            parts = F.when(plan["split"] == "none", whole).otherwise(
                micro_split(
                    section["text"],
                    target_tokens=options.micro_chunk_tokens,
                    overlap_tokens=options.micro_overlap_tokens,
                    hard_cap_tokens=options.micro_cap,
                    strategy=plan["split"],
                    count=count,
                )
            )
        else:
            parts = whole
        children = F.transform(
            parts,
            lambda part, j: block(
                part, plan["child_kind"], options.child_level_name, section, F.when(plan["split"] != "none", j)
            ),
        )
        if not options.emit_parent_chunks:
            return children
        own = F.array(block(section["text"], plan["parent_kind"], options.parent_level_name, section, _null("int")))
        return F.when(plan["split"] == "none", children).otherwise(F.concat(own, children))

    return F.flatten(F.transform(plan["sections"], expand))


def _preamble_block(header: Column, options: ChunkingOptions) -> Column:
    return F.struct(
        header.alias("text"),
        F.lit("preamble").alias("kind"),
        F.lit(options.parent_level_name).alias("level"),
        _null("string").alias("parent_id"),
        _null("int").alias("child_index"),
        _null("string").alias("symbol"),
        _null("int").alias("line_start"),
        _null("int").alias("line_end"),
    )


def _named(blocks: Column, packed: Column, plan: Column, path: Column, ext: Column, preamble: bool) -> Column:
    """Packed blocks as chunk structs with ids ``path:prefix:n``."""

    def meta(chunk: Column) -> Column:
        return F.transform(
            chunk["members"],
            lambda at: let(
                F.get(blocks, at),
                lambda b: F.struct(
                    *[b[f].alias(f) for f in ("kind", "level", "parent_id", "child_index", "symbol", "line_start", "line_end")],
                    chunk["hard_split"].alias("hard_split"),
                ),
            ),
        )

    def chunk(c: Column, i: Column) -> Column:
        number = F.concat(F.lit("preamble"), F.when(i > 0, i.cast("string")).otherwise(F.lit(""))) if preamble else i
        return F.struct(
            F.concat_ws(":", path, plan["prefix"], number).alias("id"),
            c["text"].alias("text"),
            plan["chunker"].alias("chunker"),
            plan["lang"].alias("lang"),
            ext.alias("ext"),
            F.lit(preamble).alias("preamble"),
            F.size(c["members"]).alias("block_count"),
            meta(c).alias("blocks_meta"),
        )

    return F.transform(packed, chunk).cast(CHUNKS)


def inject_context(chunks: Column, header: Column, child_level: str, separator: Column) -> Column:
    """Put the header before every chunk that holds a child block; its tokens are not counted."""
    return F.transform(
        chunks,
        lambda c: c.withField(
            "text",
            F.when(
                (header != "") & F.exists(c["blocks_meta"], lambda b: b["level"] == child_level),
                F.concat(header, separator, c["text"]),
            ).otherwise(c["text"]),
        ),
    )


def chunks_of(plan: Column, path: Column, ext: Column, options: ChunkingOptions, count: TokenCounter = word_count) -> Column:
    """Sections cut, packed, named and given their context: an array of ``CHUNK``."""
    limit = max(1, options.max_symbol_blocks_per_chunk) if options.emit_parent_chunks else None

    def build(p: Column) -> Column:
        blocks = parent_child_blocks(p, options, count)
        lead = F.array(_preamble_block(p["header"], options))
        if not options.separate_preamble_chunk:
            blocks = F.when(p["header"] != "", F.concat(lead, blocks)).otherwise(blocks)

        def packed(bs: Column) -> Column:
            body = _named(
                bs,
                pack_blocks(
                    bs,
                    chunk_tokens=options.chunk_tokens,
                    overlap_tokens=options.overlap_tokens,
                    hard_cap_tokens=options.hard_cap_tokens,
                    max_symbol_blocks_per_chunk=limit,
                    count=count,
                ),
                p,
                path,
                ext,
                False,
            )
            if options.include_context_in_children:
                return inject_context(body, p["header"], options.child_level_name, p["separator"])
            return body

        chunks = let(blocks, packed)
        if not options.separate_preamble_chunk:
            return chunks
        if options.hard_cap_tokens is None:
            alone = F.array(
                F.struct(p["header"].alias("text"), F.array(F.lit(0)).alias("members"), F.lit(False).alias("hard_split"))
            )
        else:
            alone = pack_blocks(
                lead,
                chunk_tokens=options.chunk_tokens,
                overlap_tokens=0,
                hard_cap_tokens=options.hard_cap_tokens,
                count=count,
            )
        first = _named(lead, alone, p, path, ext, True)
        return F.when(p["header"] != "", F.concat(first, chunks)).otherwise(chunks)

    return let(plan, build)


def multi_view(plans: Column, path: Column, ext: Column, options: ChunkingOptions, count: TokenCounter = word_count) -> Column:
    """Several chunkers over the same text; a repeat within one chunker is dropped."""
    views = F.flatten(F.transform(plans, lambda p: chunks_of(p, path, ext, options, count)))
    return first_of_each(
        views,
        lambda c: F.struct(
            F.sha2(c["text"], 256).alias("text"),
            c["chunker"].alias("chunker"),
            F.coalesce(c["lang"], F.lit("")).alias("lang"),
            c["ext"].alias("ext"),
        ),
    )


def structural_chunks(
    sources: DataFrame, options: ChunkingOptions | None = None, chunker: str | None = None, count: TokenCounter = word_count
) -> DataFrame:
    """``sources(path, ext, content)`` to one row per chunk, all within the row of each document.

    ``chunker`` forces one by name; otherwise the extension decides, or ``options.mode="multi"``
    runs several. ``count`` measures texts against the sizes of the options.
    """
    options = options or ChunkingOptions()
    path, ext, content = F.col("path"), F.col("ext"), F.col("content")
    if options.mode == "multi" and chunker is None:
        names = options.multi_chunkers or ("code", "brace", "text")
        plans = F.array(*[CHUNKERS.get(n, text_chunker)(path, content, options) for n in names])
        planned = sources.select("path", "ext", plans.alias("plans"))
        chunks = multi_view(F.col("plans"), path, ext, options, count)
    else:
        plan = CHUNKERS.get(chunker, text_chunker)(path, content, options) if chunker else routed(path, ext, content, options)
        planned = sources.select("path", "ext", plan.alias("plan"))
        chunks = chunks_of(F.col("plan"), path, ext, options, count)
    return planned.select("path", F.posexplode(chunks).alias("ord", "chunk")).select("path", "ord", "chunk.*")


# Annotation groups of Java frameworks.
ANNOTATION_GROUPS = {
    "spring_core.stereotype": ("@Component", "@Service", "@Repository", "@Controller", "@RestController", "@Configuration"),
    "spring_core.injection": ("@Autowired", "@Inject", "@Value", "@Qualifier", "@Primary", "@Lazy"),
    "spring_core.lifecycle": ("@PostConstruct", "@PreDestroy", "@Bean", "@Scope"),
    "spring_core.aop": ("@Aspect", "@Before", "@After", "@Around", "@Pointcut"),
    "spring_web.mapping": ("@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping"),
    "spring_web.params": (
        "@RequestBody", "@ResponseBody", "@PathVariable", "@RequestParam", "@RequestHeader", "@CookieValue",
    ),
    "spring_web.response": ("@ResponseStatus", "@ExceptionHandler", "@ControllerAdvice", "@RestControllerAdvice"),
    "spring_web.validation": ("@Valid", "@Validated"),
    "spring_data.repository": ("@Repository", "@Query", "@Modifying", "@Param"),
    "spring_data.transaction": ("@Transactional", "@EnableTransactionManagement"),
    "jpa_jakarta.entity": ("@Entity", "@Table", "@MappedSuperclass", "@Embeddable", "@Embedded"),
    "jpa_jakarta.id": ("@Id", "@GeneratedValue", "@SequenceGenerator", "@TableGenerator", "@EmbeddedId", "@IdClass"),
    "jpa_jakarta.mapping": ("@Column", "@JoinColumn", "@JoinTable", "@OrderBy", "@OrderColumn"),
    "jpa_jakarta.relations": ("@OneToOne", "@OneToMany", "@ManyToOne", "@ManyToMany", "@ElementCollection"),
    "jpa_jakarta.fetch": ("@Fetch", "@BatchSize", "@LazyCollection"),
    "jpa_jakarta.lifecycle": ("@PrePersist", "@PostPersist", "@PreUpdate", "@PostUpdate", "@PreRemove", "@PostRemove"),
    "lombok.data": (
        "@Data", "@Value", "@Builder", "@SuperBuilder", "@NoArgsConstructor", "@AllArgsConstructor",
        "@RequiredArgsConstructor",
    ),
    "lombok.accessors": ("@Getter", "@Setter", "@ToString", "@EqualsAndHashCode"),
    "lombok.utility": ("@Slf4j", "@Log", "@Log4j", "@Log4j2", "@CommonsLog", "@Cleanup", "@SneakyThrows"),
    "validation.constraints": (
        "@NotNull", "@NotBlank", "@NotEmpty", "@Size", "@Min", "@Max", "@Pattern", "@Email", "@Past", "@Future",
        "@Positive", "@Negative",
    ),
    "jackson.serialization": (
        "@JsonProperty", "@JsonIgnore", "@JsonInclude", "@JsonFormat", "@JsonSerialize", "@JsonDeserialize",
    ),
    "jackson.type": ("@JsonTypeInfo", "@JsonSubTypes", "@JsonTypeName"),
    "testing.junit": (
        "@Test", "@BeforeEach", "@AfterEach", "@BeforeAll", "@AfterAll", "@Disabled", "@DisplayName", "@Nested",
        "@ParameterizedTest",
    ),
    "testing.mockito": ("@Mock", "@InjectMocks", "@Spy", "@Captor", "@MockBean", "@SpyBean"),
    "testing.spring_test": ("@SpringBootTest", "@WebMvcTest", "@DataJpaTest", "@MockMvc", "@AutoConfigureMockMvc"),
}
ANNOTATION_CLASSES = {
    "controller": ("@Controller", "@RestController"),
    "service": ("@Service",),
    "repository": ("@Repository",),
    "configuration": ("@Configuration",),
    "entity": ("@Entity", "@MappedSuperclass"),
    "component": ("@Component",),
    "test": ("@SpringBootTest", "@WebMvcTest", "@DataJpaTest", "@Test"),
}
TYPE_WORD_CLASSES = ("class", "interface", "enum", "record")


def annotations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(@\w+)"), F.lit(1)))


def annotation_tags(found: Column) -> Column:
    """Sorted ``framework.category`` names of the annotation groups met, with what was met.

    The rule table is a literal of fixed size, so this is an intersection of small arrays per row.
    """
    hits = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("tag"),
                    F.array_sort(
                        F.array_intersect(found, F.array(*[F.lit(a) for a in members]))
                    ).alias("matched"),
                )
                for name, members in ANNOTATION_GROUPS.items()
            ]
        ),
        lambda h: F.size(h["matched"]) > 0,
    )
    return F.array_sort(hits)


def annotation_class(found: Column, fallback: Column) -> Column:
    """First class whose annotations are present, in fixed order; else the given fallback."""
    chain = None
    for name, members in ANNOTATION_CLASSES.items():
        test = F.arrays_overlap(found, F.array(*[F.lit(a) for a in members]))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(fallback)
