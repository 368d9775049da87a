"""Rules for entities and sentences. Every operator takes a rule set; ``PLATFORMS`` is one for data platforms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from weftwork.functions.text import any_of


@dataclass(frozen=True)
class Ambiguous:
    """A word that counts only with one of ``context`` within ``window`` characters, or if it matches ``cased`` as it is."""

    entity: str
    term: str
    window: int
    context: tuple[str, ...]
    cased: str | None = None


@dataclass(frozen=True)
class Rules:
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ambiguous: tuple[Ambiguous, ...] = ()
    excluded: tuple[tuple[str, str], ...] = ()
    phrases: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    moves: tuple[str, ...] = ()
    cues: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def platform(self) -> str:
        return any_of(self.platforms)

    @property
    def move(self) -> str:
        return any_of(self.moves)

    @property
    def reason(self) -> str:
        return any_of([c for group in self.cues.values() for c in group], whole_words=True)

    def of(self, entities: list[str]) -> Rules:
        """The rules that the mentions of some entities depend on: their aliases, and all that ambiguous words of theirs ask about."""
        words = tuple(a for a in self.ambiguous if a.entity in entities)
        aliases = self.aliases if words else {e: p for e, p in self.aliases.items() if e in entities}
        return replace(self, aliases=aliases, ambiguous=words, excluded=self.excluded if words else ())

    def entities(self) -> list[str]:
        """Entities that count in statistics; technologies (``tech:``) don't."""
        return [e for e in self.aliases if not e.startswith("tech:")]


# Phrases, terms and cues of the detectors, and below them aliases, ambiguous words and exclusions, on which results depend.
SWITCHING_PHRASES = ("migrated from", "moved off", "switched to", "moving from", "instead of", "evaluated", "bake-off", "bakeoff", "POC", "proof of concept", "ripped out", "replaced with", "consolidated onto")
PLATFORM_TERMS = (
    r"snowflake", r"databricks", r"cloudera", r"hortonworks", r"redshift", r"synapse", r"fabric", r"onelake", r"bigquery",
    r"big query", r"athena", r"\bemr\b", r"\bglue\b", r"dataproc", r"postgres(?:ql)?", r"duckdb", r"motherduck", r"clickhouse",
    r"trino", r"presto", r"starburst", r"dremio", r"firebolt", r"vertica", r"teradata", r"netezza", r"greenplum", r"\boracle\b",
    r"sql server", r"mysql", r"hadoop", r"\bhdfs\b", r"\bhive\b", r"impala", r"\bspark\b", r"iceberg", r"delta lake", r"\bhudi\b",
    r"\bs3\b", r"\baws\b", r"azure", r"\bgcp\b", r"google cloud", r"on-?prem(?:ise|ises)?\b", r"data ?warehouse", r"lakehouse",
    r"data lake",
)
MOVE_PHRASES = (
    r"migrat(?:ed|ing|ion) (?:from|to|off)", r"mov(?:ed|ing) (?:off|away from|from|to|over to)", r"switch(?:ed|ing) (?:from|to|over)",
    r"replac(?:ed|ing)\b", r"ripped out", r"consolidat(?:ed|ing) onto", r"(?:chose|picked|went with|opted for|settled on)\b",
    r"evaluat(?:ed|ing)\b", r"bake-?off", r"proof of concept", r"\bPOC\b", r"ditched", r"instead of", r"alternative to",
    r"rather than", r"compared (?:to|with)", r"\bvs\.?(?=\s)", r"versus", r"wins on", r"why we",
)
REASON_CUES = {
    "cost": (r"costs?", r"costly", r"bills?", r"billing", r"pricing", r"priced", r"expensive", r"cheap(?:er)?", r"savings?", r"saved", r"budget"),
    "performance_scale": (r"faster", r"slower", r"performance", r"latency", r"scal(?:e|es|ing|ability)"),
    "right_sizing": (r"overkill",),
    "lock_in_openness": (r"lock(?:ed)?[- ]in", r"locked into", r"proprietary", r"open (?:source|formats?|table formats?)"),
    "operational_simplicity": (r"simpl(?:er|icity|e)", r"complex(?:ity)?", r"user[- ]friendly", r"maintain", r"maintenance"),
    "governance_security": (r"governance", r"permissions?", r"security", r"compliance"),
    "ecosystem_fit": (r"ecosystem", r"integrat(?:ion|ions|es|ed)"),
}
ALIASES = {
    "databricks": (r"\bdatabricks\b", r"\bunity catalog\b"),
    "snowflake": (r"\bsnowpark\b", r"\bsnowpipe\b", r"\bsnowsql\b", r"\bsnowflake (?:cortex|computing|data cloud|marketplace)\b", r"\bsnowflake\.com\b"),
    "cloudera": (r"\bcloudera\b", r"\bhortonworks\b"),
    "aws": (r"\b(?:amazon|aws) redshift\b", r"\bredshift (?:serverless|spectrum)\b", r"\baws glue\b", r"\bglue (?:catalog|jobs?|etl|crawlers?|data catalog)\b"),
    "microsoft": (r"\bmicrosoft fabric\b", r"\bms fabric\b", r"\bfabric (?:lakehouse|warehouse|capacity|notebooks?)\b", r"\bonelake\b", r"\bazure synapse\b", r"\bsynapse analytics\b"),
    "google": (r"\bbigquery\b", r"\bbig query\b"),
    "tech:delta_lake": (r"\bdelta lake\b", r"\bdelta(?:-io| tables?| format| live tables| sharing)\b"),
    "tech:apache_spark": (r"\bapache spark\b", r"\bpyspark\b", r"\bspark ?sql\b", r"\bspark (?:streaming|structured streaming)\b"),
}
AMBIGUOUS = (
    Ambiguous(
        "snowflake", r"\bsnowflake\b", 200,
        (r"warehous", r"\bsql\b", r"\bquer(?:y|ies)\b", r"\bdata\b", r"databricks", r"bigquery", r"redshift", r"\bdbt\b", r"cortex", r"snowpark", r"\bcredits?\b", r"\bcloud\b", r"\bel?tl?\b", r"iceberg",
         r"analytics", r"\btables?\b", r"pipelines?", r"\bsaas\b", r"lakehouse", r"\bs3\b", r"fivetran", r"\bstages?\b", r"storage integration", r"\bazure\b", r"\baws\b", r"\bgcp\b", r"snowsight", r"\bipo\b",
         r"postgres", r"\bspark\b", r"\bclusters?\b", r"\bcompute\b", r"\bceo\b", r"\bstock\b", r"earnings", r"slootman", r"arctic", r"\bcolumns?\b", r"\bselect\b", r"\bjoin\b", r"\bcte\b", r"procedures?",
         r"\bfunctions?\b", r"\bconnect(?:ion|ions|or|ors)?\b", r"\bdrivers?\b", r"\bsdk\b", r"\bdb\b", r"databases?", r"json", r"regex", r"\binsert\b", r"datetime", r"\btasks?\b", r"snowflakedb", r"\bcli\b",
         r"\bjava\b", r"\bnode(?:js)?\b", r"streamlit", r"duckdb", r"clickhouse", r"\bmfa\b", r"\binstance\b", r"integrations?", r"resource monitor", r"embedding", r"\bvariant\b", r"quicksight", r"r/snowflake",
         r"\bapi\b", r"github\.com/snowflake"),
        r"Snowflake\b",
    ),
    Ambiguous("aws", r"\bredshift\b", 200, (r"\baws\b", r"\bamazon\b", r"warehouse", r"\bclusters?\b", r"\bsql\b", r"\bquer(?:y|ies)\b", r"\betl\b", r"\bs3\b", r"snowflake", r"bigquery", r"databricks", r"\bdbt\b")),
    Ambiguous("microsoft", r"\bsynapse\b", 200, (r"\bazure\b", r"microsoft", r"\bfabric\b", r"\bsql pools?\b", r"\bspark pools?\b", r"dedicated pool", r"serverless", r"warehouse", r"pipelines?", r"power ?bi", r"data factory", r"databricks", r"snowflake")),
    Ambiguous("tech:delta_lake", r"\bdelta\b", 120, (r"\blake(?:house)?\b", r"iceberg", r"\bhudi\b", r"parquet", r"table format", r"databricks", r"\bspark\b", r"time travel", r"\bmerge into\b", r"unity catalog")),
    Ambiguous("tech:apache_spark", r"\bspark\b", 120, (r"\bclusters?\b", r"executors?", r"dataframes?", r"\bjobs?\b", r"hadoop", r"\bemr\b", r"\bscala\b", r"\brdds?\b", r"databricks", r"\bhive\b", r"\bkafka\b", r"shuffle", r"\bdriver\b", r"parquet", r"iceberg", r"\bdelta (?:lake|tables?)\b")),
)
EXCLUDED = (
    ("snowflake", r"\bsnowflake[\s-]+(?:schemas?|model(?:l?ing)?|dimensions?|design)\b"),
    ("snowflake", r"\b(?:special|unique|little|precious|beautiful|fresh|delicate|perfect|fragile|sensitive)[\s-]+snowflakes?\b"),
    ("snowflake", r"\b(?:its|it's|their|his|her|my|your|own|kind|fractal \w+)\s+(?:own\s+)?(?-i:snowflake)\b"),
    ("snowflake", r"\bsnowflake\s+(?:servers?|ids?|status|generation)\b"),
    ("snowflake", r"\b(?:call|called|calling)\s+(?:(?:me|them|him|her|you|us|someone|people|everyone)\s+)?(?:a\s+)?snowflakes?\b"),
    ("snowflake", r"\b(?:such|being|what|you're|youre|they're|theyre|he's|she's|i'm)\s+a\s+snowflake\b"),
    ("snowflake", r"\bsnowflakes\b"),
    ("snowflake", r"\b(?:koch snowflake|snowflake koch|snowflake bentley|tor(?:'s)? snowflake|twitter(?:'s)? snowflake|snowflake (?:proxy|proxies|volunteer|method|growth|generator|animation)|snowflake,? an? (?:censorship|android app))\b|\bsnowflake \(slang\)"),
    ("microsoft", r"\bfabric\b"),
    ("aws", r"\bglue\b"),
)

PLATFORMS = Rules(ALIASES, AMBIGUOUS, EXCLUDED, SWITCHING_PHRASES, PLATFORM_TERMS, MOVE_PHRASES, REASON_CUES)
