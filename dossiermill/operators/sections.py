"""Quality checks of whole records, section by section, and across sections.

``facts`` reads a record's JSON text twice, natively: once into the fields that rules
name (a nested field stays JSON text) and once into the sections' texts, both only of the
sections that the chosen rules read. All rules are predicates over those columns. A rule that looks for words is a row of KEYWORDS: it
fires where none of the words is in the section, given one of some hazard codes.

A section with an empty-rule has its other rules only if it is not empty. Rules that
report failures of the checks themselves do not exist here, since expressions do not
raise. Dates are compared with ``as_of``, never with the clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chemistry
from ..sources.schema import NUMBERED
from .rules import Rule, findings

#: A string of JSON text that is no key (group 1); keys are passed over.
_LEAF = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:|("[^"\\]*+(?:\\.[^"\\]*+)*+")'
_NUMBER = r'"(?:ExactValue|LowerValue|UpperValue)"\s*:\s*\{[^{}]*?"Value"\s*:\s*"?(-?[0-9][0-9.eE+-]*)"?'
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "

_NAMES = "struct<GenericName:string,IupacName:string>"
_COMPONENT = (
    f"struct<SubstanceIdentifiers:struct<SubstanceIdentity:struct<CASno:struct<FullText:string>,MolecularWeight:string>,SubstanceNames:{_NAMES}>,"
    "Concentration:string>"
)
#: The fields that rules name; nested ones of type string keep their JSON text.
FIELDS = {
    "Datasheet": "struct<IssueDate:string,RevisionDate:string>",
    "Identification": "struct<TradeProductIdentity:struct<TradeNameJP:string,TradeNameEN:string>,"
    "SupplierInformation:struct<CompanyName:string,Phone:string,EmergencyContact:string>,UseAndUseAdvisedAgainst:struct<Use:string>,EmergencyContact:string>",
    "Composition": "struct<CompositionType:string,CompositionAndConcentration:string>",
    "FirstAidMeasures": "struct<ExposureRoute:struct<FirstAidEye:string,FirstAidIngestion:string,FirstAidInhalation:string,FirstAidSkin:string>>",
    "HandlingAndStorage": "struct<SafeHandling:string,Storage:string>",
    "ExposureControlPersonalProtection": "struct<AppropriateEngineeringControls:string,EngineeringControls:string,OccupationalExposureLimits:string,OEL:string,"
    "PersonalProtectionEquipment:struct<EyeProtection:string,HandProtection:string,RespiratoryProtection:string,SkinProtection:string,BodyProtection:string>>",
    "PhysicalChemicalProperties": "struct<BasePhysicalChemicalProperties:struct<Colour:string,Appearance:string,PhysicalState:string,Odour:string,RelativeDensity:string,pH:string>,"
    "Densities:string,Density:string,Solubilities:struct<WaterSolubility:string>,OtherPhysicalChemicalProperty:string,FlashPoint:string,BoilingPointRelated:string,"
    "MeltingPointRelated:string,AutoIgnitionTemperature:string,VapourPressure:string,VaporPressure:string>",
    "StabilityReactivity": "struct<IncompatibleMaterials:string,HazardousDecompositionProducts:string>",
    "ToxicologicalInformation": "string", "OtherInformation": "string",
}
#: The sections that the rules of a part of the catalogue read, beside the hazards; of parts
#: that are not named here, all.
READS = {
    "S1": ["Identification"], "S2": [], "S3": ["Composition"], "S4": ["FirstAidMeasures"], "S5": ["FireFightingMeasures"], "S6": ["AccidentalReleaseMeasures"],
    "S7": ["HandlingAndStorage"], "S8": ["ExposureControlPersonalProtection", "Composition"], "S9": ["PhysicalChemicalProperties"], "S10": ["StabilityReactivity"],
    "S11": ["ToxicologicalInformation"], "S12": ["EcologicalInformation", "PhysicalChemicalProperties"], "S13": ["DisposalConsiderations"],
    "S14": ["TransportInformation"], "S15": ["RegulatoryInformation"], "S16": ["Datasheet", "OtherInformation"],
}
#: The sections whose fields the rules across sections read.
FIELDS_ACROSS = ["Datasheet", "Composition"]
_TOX = "struct<AcuteToxicity:string,SkinCorrosionIrritation:string,EyeDamageOrIrritation:string,Sensitization:string,Carcinogenicity:string,ReproductiveToxicity:string,SpecificTargetOrgan:string>"

# Groups of hazard codes.
FLAMMABLE = "H224 H225 H226".split()
INHALED = "H330 H331 H332 H333 H334 H335".split()
DANGEROUS_GOODS = "H224 H225 H226 H300 H301 H302 H310 H311 H314 H330 H331 H332 H270 H271 H272".split()
AQUATIC = "H400 H401 H402 H410 H411 H412 H413".split()
REACTIVE = "H260 H261 H270 H271 H272 H240 H241 H242 H290".split()
EXPLOSIVE = "H200 H201 H202 H203 H204 H205 H240 H241 H242".split()
ACUTE = "H300 H301 H302 H310 H311 H312 H330 H331 H332".split()
SKIN = "H314 H315 H316 H317".split()
PRTR = "H350 H351 H340 H341 H400 H410".split()

# Patterns of words and notations, upper and lower case alike.
PROPRIETARY = r"proprietary|trade.?secret|confidential|not.?disclosed|withheld|未特定|機密|専売品|不明|秘密|未公開|営業秘密|商业机密|保密|不公开|未知"
NOT_REGULATED = r"not regulated|非危険物|not dangerous|無資料|規制されていない|規制対象外|危険物に該当しない|not subject|no regulation|非危险|该当なし|该当しない|not classify|not applicable|n/a"
UN_NUMBER = r"\bUN\s?\d{4}\b|UN\s*[Nn][Oo][\.\s]*[)）]?\s*[：:]\s*\d{4}|聯合國編號[^0-9]{0,10}\d{4}|联合国编号[^0-9]{0,10}\d{4}|联合国危险货物编号[^0-9]{0,10}\d{4}"
EYE_WORDS = r"eye|眼|rinse|洗眼|目|look\b|コンタクトレンズ|まぶた|contact.*lens|eyelid"
CLOTHING = r"remov.*cloth|take.?off.*cloth|contaminat.*cloth|衣類.*脱|脱.*衣|汚染.*衣|除去.*衣|脱去.*衣|立即.*脱|立刻.*脱|脱掉|脫掉|脫去|脫.*衣"
DEGREES = r"\d+\s*[°℃]|\d+\s*°C|\d+\s*degrees?|below\s+\d+"
COOL = r"涼しい|冷所|冷暗|low temperature|冷凉处|低温|keep cool|cool place|cool.*area|cool.*dry|cool.*location|阴凉|陰涼"
OEL_NUMBER = r"\d+\.?\d*[*＊]*\s*(mg/m|ppm|mg/L|f/cc|µg)|(mg/m\d*|ppm|mg/L)[^0-9A-Za-z]{0,5}\d+\.?\d*"
OEL_NONE = (
    r"設定されていない|not established|not set|no limit|not available|情報なし|なし|N/A|does not contain|含有していない|含まれていない|限界値.*含有|"
    r"no hazardous material|no applicable|not required|no substances.*limit|没有.*接触限值|无职业接触限值|不适用|无需监控|未制订|无资料|不监控|监视.*不.*含|"
    r"该产品不含|不要求|未設定|使用粉尘的职业接触限值|在控制.*职业接触限值|不含.*職業接觸限值|不含.*職業暴露極限值|不含有职业接触限值|不含.*职业接触限值|"
    r"无.*职业接触限值的物质|無相關|無相關職業接觸限值|無相關職業暴露|無資料|\b無\b|\b无\b|No biological limit|no.*biological.*limit|not.*allocated|"
    r"無職業接觸限值|未建立職業接觸限值|無職業接觸限值資料|[：:]\s*[-－—]\s*[；;]|[：:]\s*[-－—]\s*$"
)
GLOVES = r"nitrile|butyl|neoprene|rubber|latex|viton|PVC|polyethylene|ニトリル|ブチル|ネオプレン|ゴム|丁腈|丁基|氯丁|橡胶|橡膠"
RESPIRATORS = r"P1|P2|P3|A1|ABEK|FFP|half mask|full face|SCBA|P100|organic vapor|防毒|防じん|送気|有机蒸气|防尘|organic vapour|half-face|full-face"
SOLUBLE = r"水溶|water solub|水分散|water\s*solub|溶解度|solubility"
NO_FLASH = r"情報なし|not applicable|n/a|なし|no data|沸騰するまで引火せず|引火しない|非引火性|不燃|None detected|not detected|no flash point detected|not measurable"
AUTO_IGNITION = r"auto.ignit|autoignit|自然発火|自燃|引火"
LOG_P = r"LogP|Kow|BCF|partition coefficient|分配係数|辛醇|logkow|log P|正辛醇|オクタノール"
LD50 = r"LD50|LC50|mg/kg|ml/kg|mg/l|mg/L|µg|lethal"
CARCINOGEN_CLASS = r"IARC|NTP|ACGIH|WHO|NIOSH|Group|Class|カテゴリ|分类|分類"
PLACEHOLDER = r"\[insert|\[記入|PLACEHOLDER|TODO\b|TBD\b"
ACIDS = r"acid|chloride|chloro|fluor|sulfate|hydro|酸|塩化|フッ化|硫酸|塩酸|硝酸|酸|氯|氟|硫"
SOLID = r"solid|固体|固形|crystalline|結晶|晶"

# Fixed values: (rule, section, codes of which one is needed or none, words of which one
# has to be in the section's text).
KEYWORDS = [
    ("S4-INHAL-HCODE-NO-INHAL-AID", "FirstAidMeasures", INHALED, r"inhal|吸入|fresh air|新鮮な空気|空気|換気|通風|呼吸"),
    ("S4-SKIN-HCODE-NO-SKIN-AID", "FirstAidMeasures", ["H314", "H315"], r"skin|皮膚|wash|洗|水|water"),
    ("S5-NO-EXTINGUISHING-AGENT", "FireFightingMeasures", None, r"foam|water|CO2|carbon dioxide|powder|sand|dry chemical|halon|nitrogen|inert gas|extinguish|泡|二酸化炭素|炭酸|粉末|砂|消火|灭火|水雾|dry sand|surrounding|appropriate|水|泡沫|粉|ABC|foam|spray"),
    ("S6-NO-CLEANUP-KEYWORDS", "AccidentalReleaseMeasures", None, r"absorb|collect|sweep|dike|sand|berm|ventilat|吸収|吸收|回収|回收|吸附|収集|收集|围堤|围堵|通风|通風|盛土|乾燥砂|おがくず|乾燥|砂|沙|吸着|囲|收容|处置|處置"),
    ("S7-FLAMMABLE-NO-HEAT-KW", "HandlingAndStorage", FLAMMABLE, r"cool|heat|ignition|flame|spark|火気|冷所|远离|冷暗|炎|点火"),
    ("S7-WATER-REACTIVE-NO-DRY", "HandlingAndStorage", ["H260", "H261", "H250"], r"dry|moisture|water|乾燥|防湿|水分|湿気|dry"),
    ("S7-VOLATILE-NO-VENTILATION", "HandlingAndStorage", INHALED + FLAMMABLE, r"ventilat|exhaust|fume hood|換気|局排|通风|排気|ventilation"),
    ("S8-H314-NO-FACE-SHIELD", "ExposureControlPersonalProtection", ["H314"], r"face shield|goggles|フェイス|ゴーグル|面罩|护目"),
    ("S10-NO-STABILITY-KEYWORDS", "StabilityReactivity", None, r"avoid|heat|temperature|incompatible|oxidiz|decompos|acid|reaction|processing|酸化|禁止|分解|stable|stability|安定|不安定|稳定|穩定|反応|反应|反應|氧化|不相容|避免|conditions|条件|materials|物質"),
    ("S12-NO-AQUATIC-KEYWORDS", "EcologicalInformation", AQUATIC, r"aquatic|fish|daphnia|algae|LC50|EC50|水生|魚|甲殻|藻類|水产|毒性"),
    ("S12-H410-NO-BIODEG", "EcologicalInformation", ["H410", "H411"], r"biodeg|bioaccum|BCF|PersistenceDeg|生分解|生物濃縮|生物蓄積|持続性|生态|降解|蓄积"),
    ("S12-H420-NO-OZONE", "EcologicalInformation", ["H420"], r"ODP|ozone|stratosph|オゾン|臭氧|オゾン破壊|ODS"),
    ("S13-NO-DISPOSAL-KEYWORDS", "DisposalConsiderations", None, r"inciner|landfill|waste|regulation|dissipat|廃棄|廢棄|廃液|廢液|焼却|焚烧|焚燒|废物|廢物|廢棄物|処分|処理|處理|处置|處置|废弃|廢棄|丢弃|弃置|官方.*规章|规章|法规|法律.*处置|处置.*法规|消散|气瓶|氣瓶|返.*供[应應]商|法規|環保法規"),
    ("S15-NO-LAW-KEYWORDS", "RegulatoryInformation", None, r"law|regulation|安全衛生|化審法|消防法|毒劇法|化管法|GB|REACH|OSHA|RoHS|CLP|規制|法令|法律|规定|立法|条例|基準|指令|directive|労働基準|化学物質|办法|管理办法|规范|規範|名录|名錄|管制|IECSC|化学品|危险化学|安全生产|化学品登记|环境管理"),
]
PHYSICIAN = r"doctor|physician|medical|医師|醫師|就医|就醫|医生|醫生|医疗|醫療|就診|求醫|求医|就诊|医院|seek medical|診断|手当|送醫|送医"
INCOMPATIBLE = r"incompatible|禁水|water|acid|alkali|oxidiz|避ける|禁止|回避|不相容"
PACKING_GROUP = r"packing group|PG\s?[IVXivx]+|危険物容器|容器等級|容器包装等級|包裝類別|包裝等級|包装类别|[ⅠⅡⅢⅣⅤ]"
SHIPPING_NAME = r"proper shipping|品名|品番|shipping name|品目名|正式品名|聯合國運輸名稱|运输名称|運輸名稱"
JA_LAW = r"労働安全衛生法|安衛法|化審法|毒劇法|消防法|化管法|PRTR|安全衛生"
GB_STANDARD = r"GB\s?\d|GBZ|GB/T|GB\s+\d|国家标准"


# --- reading a record ---------------------------------------------------------


def normalized(text: Column) -> Column:
    """Full-width ASCII made narrow and the degree sign spelled out, so that patterns of
    units and numbers see one form. Most texts have neither and are left as they are."""
    changed = F.replace(F.translate(text, _WIDE, _NARROW), F.lit("℃"), F.lit("°C"))
    # plain ASCII is told by its length, and the first bytes of wide signs are found sooner than a pattern
    first = [F.contains(text.cast("binary"), F.lit(x)) for x in (b"\xef\xbc", b"\xef\xbd", "\u3000".encode(), "\u2103".encode())]
    wide = (F.octet_length(text) > F.char_length(text)) & (first[0] | first[1] | first[2] | first[3])
    return F.when(wide, changed).otherwise(text)


def leaves(raw: Column) -> Column:
    """The string leaves of JSON text, in order; of text that is no object or list, the
    text itself. Null has none."""
    found = F.array_remove(F.regexp_extract_all(raw, F.lit(_LEAF), F.lit(1)), "")
    strings = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    nested = F.ltrim(raw).rlike(r"^[\[{]")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(nested, strings).otherwise(F.array(raw))


def text_of(raw: Column) -> Column:
    return normalized(F.array_join(leaves(raw), " "))


def numbers(raw: Column) -> Column:
    """The values of the quantities in JSON text, in text order."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_NUMBER), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def items(raw: Column) -> Column:
    """The entries of a JSON list, or the one entry that is no list."""
    none = F.array().cast("array<string>")
    return F.when(raw.isNull(), none).when(F.ltrim(raw).rlike(r"^\["), F.coalesce(F.from_json(raw, "array<string>"), none)).otherwise(F.array(raw))


def facts(records: DataFrame, parts: tuple[str, ...] | None = None) -> DataFrame:
    """``records`` (lang, record: JSON text, ...) with what the rules of ``parts`` of the
    catalogue (None: all) read: ``r`` (FIELDS), the texts of sections and fields, the codes h
    and p, mixture, components and other properties. A record that is null, broken or no
    JSON object has no sections."""
    every = ["Datasheet", *NUMBERED]
    if parts is None or any(p not in READS for p in parts):
        own = every
    else:
        own = [s for s in every if s == "HazardIdentification" or any(s in READS[p] for p in parts)]
    named = [s for s in own if s in FIELDS and (parts is None or any(s in {**READS, "CX": FIELDS_ACROSS}.get(p, FIELDS) for p in parts))]
    record = F.when(F.col("record").rlike(r"^\s*\{"), F.col("record"))
    read = records.withColumn("sections", F.from_json(record, ", ".join(f"{s} string" for s in own)))
    fields = ", ".join(f"{s} {FIELDS[s]}" for s in named)
    if fields:
        read = read.withColumn("r", F.from_json(record, fields))
    # a column for each text, so that what no rule reads is never made, and for each step of it,
    # so that what the next one reads more than once is made once
    raw = {f"t_{s}": F.col("sections")[s] for s in own if s in NUMBERED}
    if fields:
        raw |= {_name(path): F.col(f"r.{path}") for path in _paths(T.StructType.fromDDL(fields))}
    read = read.withColumns({f"l_{n}": leaves(x) for n, x in raw.items()} | {"whole": normalized(F.col("record"))})
    read = read.withColumns({f"j_{n}": F.coalesce(F.array_join(f"l_{n}", " "), F.lit("")) for n in raw})
    read = read.withColumns({n: normalized(F.col(f"j_{n}")) for n in raw}).withColumn("h_text", _text("HazardIdentification"))
    more = {
        "h": F.array_distinct(F.regexp_extract_all("h_text", F.lit(r"\b(H[2-4]\d{2}[A-Z]?)\b"), F.lit(1))),
        "p": F.array_distinct(F.regexp_extract_all("h_text", F.lit(r"\b(P\d{3})\b"), F.lit(1))),
    }
    if "Composition" in named:
        more |= {
            "mixture": F.coalesce(F.lower("r.Composition.CompositionType").isin("混合物", "mixture"), F.lit(False)),
            "components": F.coalesce(F.from_json(F.array_join(F.concat(F.array(F.lit("[")), F.array(F.array_join(items(F.col("r.Composition.CompositionAndConcentration")), ",")), F.array(F.lit("]"))), ""), f"array<{_COMPONENT}>"), F.array().cast(f"array<{_COMPONENT}>")),
        }
    if "PhysicalChemicalProperties" in named:
        more |= {
            "other": F.coalesce(F.transform(items(F.col("r.PhysicalChemicalProperties.OtherPhysicalChemicalProperty")), lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.ItemName"), F.lit("")).alias("name"), x.alias("raw"))), F.array().cast("array<struct<name:string,raw:string>>")),
            "flash": F.get(numbers(F.col("r.PhysicalChemicalProperties.FlashPoint")), 0),
            "boiling": F.get(numbers(F.col("r.PhysicalChemicalProperties.BoilingPointRelated")), 0),
        }
    if "ToxicologicalInformation" in named:
        more["tox"] = F.transform(items(F.col("r.ToxicologicalInformation")), lambda x: F.from_json(x, _TOX))
    return read.withColumns(more)


# --- predicates ---------------------------------------------------------------


def _text(section: str) -> Column:
    return F.col(f"t_{section}")


def _name(path: str) -> str:
    return "f_" + path.replace(".", "_")


def _paths(fields: T.StructType) -> list[str]:
    """The paths of all string fields."""
    out = []
    for f in fields:
        out += [f"{f.name}.{p}" for p in _paths(f.dataType)] if isinstance(f.dataType, T.StructType) else [f.name]
    return out


def _field(path: str) -> Column:
    return F.col(_name(path))


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def _size(c: Column) -> Column:
    return F.char_length(F.trim(c))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern; those inside brackets are none of its own."""
    out, depth, listed = [""], 0, False
    for token in re.findall(r"\\.|.", pattern):
        if token == "|" and depth == 0 and not listed:
            out.append("")
            continue
        listed = token != "]" if listed else token == "["
        depth += 0 if listed else (token == "(") - (token == ")")
        out[-1] += token
    return out


#: An ASCII sign that stands for itself.
_ESCAPED = r"\\([!-/:-@\[-`{-~])"


def _words(alternative: str) -> list[str]:
    """Words that a text with the alternative has to have, in lower case; none if it is not
    made of words between wildcards."""
    # signs behind a backslash are signs of the word; until it is cut they stand where no pattern has any
    kept = re.sub(_ESCAPED, lambda m: chr(0xE000 + ord(m[1])), alternative)
    words = [x for x in re.split(r"(?:\.|\\[sbd])(?:[*+?]|\{\d+\})?", kept) if x]
    # of the letters beyond ASCII only those without case
    plain = all(re.fullmatch(r"[^\\.\[\](){}*+?^$|]+", x) and all(c.isascii() or c.lower() == c.upper() for c in x) for x in words)
    return [re.sub("[\uE000-\uE07F]", lambda m: chr(ord(m[0]) - 0xE000), x).lower() for x in words] if plain else []


def _has(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found, upper and lower case alike. A pattern takes 30
    microseconds over a short text, so alternatives that are plain words are looked for
    as such, and those of words between wildcards only if a text has the words."""
    of = {a: _words(a) for a in _alternatives(pattern)}
    alone = lambda a: [re.sub(_ESCAPED, r"\1", a).lower()]
    literal = [w[0] for a, w in of.items() if w == alone(a)]
    guarded = {a: w for a, w in of.items() if w and w != alone(a)}
    bare = [a for a, w in of.items() if not w]

    # letters that only regular expressions take for ASCII ones
    folded = F.lower(F.replace(F.replace(F.replace(c, F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i")), F.lit("İ"), F.lit("i")))

    def found(t: Column, words: list[list[str]]) -> Column:
        return F.exists(F.array(*(F.array(*map(F.lit, w)) for w in words)), lambda w: F.forall(w, lambda x: F.contains(t, x)))

    def worded(t: Column) -> Column:
        some = [found(t, [[w] for w in literal])] if literal else []
        some += [found(t, list(guarded.values())) & c.rlike("(?iU)" + "|".join(guarded))] if guarded else []
        return some[0] | some[1] if len(some) > 1 else some[0]

    # the text is folded once for all words
    tests = [F.exists(F.array(folded), worded)] if literal or guarded else []
    if bare:
        tests.append(c.rlike("(?iU)" + "|".join(bare)))
    return tests[0] | tests[1] if len(tests) > 1 else tests[0]


def _codes(codes: list[str]) -> Column:
    return F.arrays_overlap("h", F.array(*map(F.lit, codes)))


def _hazardous() -> Column:
    return F.size("h") > 0


def _katakana(c: Column) -> Column:
    return c.rlike(r"[\x{30A0}-\x{30FF}]")


def _not_ja() -> Column:
    return ~F.col("lang").eqNullSafe(F.lit("ja"))


Test = Callable[[], Column]


def _given(gate: Test, rows: list[tuple[str, str, Test]]) -> list[Rule]:
    """Rules that are looked at only where the gate holds."""
    return [Rule(level, name, lambda t=test: gate() & t(), name) for level, name, test in rows]


def _keywords(section: str) -> list[tuple[str, str, Test]]:
    def absent(codes: list[str] | None, words: str) -> Column:
        missing = ~_has(_text(section), words)
        return missing if codes is None else _codes(codes) & missing

    return [("MED", name, lambda c=codes, w=words: absent(c, w)) for name, of, codes, words in KEYWORDS if of == section]


def _always() -> Column:
    return F.lit(True)


def section1() -> list[Rule]:
    name = lambda: F.concat(_field("Identification.TradeProductIdentity.TradeNameJP"), _field("Identification.TradeProductIdentity.TradeNameEN"))
    company, phone = lambda: _field("Identification.SupplierInformation.CompanyName"), lambda: _field("Identification.SupplierInformation.Phone")
    contacts = lambda path: F.transform(items(F.col(f"r.Identification.{path}")), text_of)
    own = lambda: contacts("EmergencyContact")
    either = lambda: F.when(F.size(own()) > 0, own()).otherwise(contacts("SupplierInformation.EmergencyContact"))
    digits = lambda: F.char_length(F.regexp_replace(phone(), r"(?U)\D", ""))
    return _given(_always, [
        ("CRIT", "S1-NO-PRODUCT-NAME", lambda: _blank(name())),
        ("CRIT", "S1-KATAKANA-PRODUCT-NAME", lambda: _not_ja() & _katakana(name())),
        ("HIGH", "S1-ALL-SUPPLIER-FIELDS-ABSENT", lambda: F.col("r.Identification.SupplierInformation").isNull() & _hazardous()),
        ("HIGH", "S1-NO-COMPANY-NAME", lambda: _blank(company())),
        ("HIGH", "S1-KATAKANA-COMPANY-NAME", lambda: _not_ja() & _katakana(company())),
        ("MED", "S1-NO-PHONE", lambda: _blank(phone())),
        ("MED", "S1-SHORT-PHONE", lambda: ~_blank(phone()) & (digits() < 7)),
        ("MED", "S1-NO-USE", lambda: _blank(_field("Identification.UseAndUseAdvisedAgainst.Use"))),
        ("MED", "S1-EMERGENCY-NO-PHONE", lambda: F.exists(own(), lambda x: (F.trim(x) != "") & ~x.rlike(r"(?U)\d"))),
        ("MED", "S1-ZH-NO-EMERGENCY", lambda: F.col("lang").isin("zh-cn", "zh-tw") & ~_blank(company()) & ~F.exists(either(), lambda x: F.trim(x) != "")),
    ])


def code_formats() -> list[Rule]:
    """Codes of the hazard section that are written like codes and are none."""
    h = lambda: F.regexp_extract_all("h_text", F.lit(r"\b(H\d{3,4}[A-Z]?)\b"), F.lit(1))
    p = lambda: F.regexp_extract_all("h_text", F.lit(r"\b(P\d{3,4})\b"), F.lit(1))
    return _given(_always, [
        ("HIGH", "S2-H-FORMAT", lambda: F.exists(h(), lambda x: ~x.rlike(r"^H[2-4]\d{2}[A-Z]?$"))),
        ("HIGH", "S2-P-FORMAT", lambda: F.exists(p(), lambda x: ~x.rlike(r"^P\d{3}$"))),
    ])


def _parts(components: Column) -> Column:
    """What the composition rules read of each component."""

    def part(c: Column) -> Column:
        identity, names = c["SubstanceIdentifiers"]["SubstanceIdentity"], c["SubstanceIdentifiers"]["SubstanceNames"]
        cas = F.filter(F.transform(items(identity["CASno"]["FullText"]), lambda x: F.trim(x)), lambda x: (x != "") & ~_has(x, PROPRIETARY))
        conc = c["Concentration"]
        more = text_of(F.get_json_object(conc, "$.AdditionalInfo"))
        return F.struct(
            F.transform(cas, lambda x: F.struct(x.alias("cas"), chemistry.cas_status(x, chemistry.QC_CAS_FORMAT).alias("status"))).alias("cas"),
            F.coalesce(names["GenericName"], F.lit("")).alias("generic"), F.coalesce(names["IupacName"], F.lit("")).alias("iupac"),
            numbers(identity["MolecularWeight"]).alias("weights"), F.coalesce(text_of(conc), F.lit("")).alias("conc"), numbers(conc).alias("values"),
            ((F.coalesce(F.get_json_object(conc, "$.NumericRangeWithUnitAndQualifier.Unit"), F.lit("")) != "") & (F.coalesce(more, F.lit("")) == "")).alias("unit"),
        )

    return F.transform(components, part)


def with_parts(read: DataFrame) -> DataFrame:
    """``read`` with parts, and over all of them cas, values and the number of parts that
    have a unit and no value."""
    read = read.withColumn("parts", _parts(F.col("components")))
    return read.withColumns({
        "cas": F.flatten(F.transform("parts", lambda c: c["cas"])),
        "values": F.flatten(F.transform("parts", lambda c: c["values"])),
        "n_unit_only": F.size(F.filter("parts", lambda c: c["unit"] & (F.size(c["values"]) == 0))),
    })


def section3() -> list[Rule]:
    n = lambda: F.size("parts")
    some = lambda: n() > 0
    of_status = lambda wanted: F.transform(F.filter("cas", lambda x: x["status"] == wanted), lambda x: x["cas"])
    mixture = lambda: F.col("mixture")
    all_missing = lambda: mixture() & (n() > 2) & (F.size("values") == 0)
    most_missing = lambda: mixture() & (n() > 3) & ~all_missing() & (F.col("n_unit_only") * 2 > n())
    single = lambda: ~mixture() & (n() == 1)
    only = lambda: F.get("parts", 0)
    bare_cas = lambda x: F.trim(x).rlike(r"^\d{1,7}-\d{2}-\d$")
    total = lambda: F.aggregate("values", F.lit(0.0), lambda s, x: s + x)

    def each(level: str, name: str, entries: Test) -> Rule:
        return Rule(level, name, entries, lambda x: F.concat(F.lit(f"{name}: "), x), each=True)

    def rows(level: str, name: str, test: Callable[[Column], Column]) -> Rule:
        return each(level, name, lambda: F.transform(F.filter("parts", test), lambda c: c["generic"]))

    def again() -> Column:
        """The valid numbers that stand earlier too: all of them but one of each."""
        valid = of_status("ok")
        return F.filter(valid, lambda x, i: F.array_position(F.transform(F.filter("cas", lambda y: y["status"] == "ok"), lambda y: y["cas"]), x) <= i)

    weights = lambda: F.flatten(F.transform("parts", lambda c: c["weights"]))
    return [
        Rule("CRIT", "S3-EMPTY", lambda: n() == 0, "S3-EMPTY"),
        *_given(some, [
            ("MED", "S3-MIXTURE-ONE-COMPONENT", lambda: mixture() & (n() == 1)),
            ("MED", "S3-MIXTURE-TOO-MANY", lambda: mixture() & (n() > 10)),
        ]),
        each("HIGH", "S3-CAS-FORMAT", lambda: of_status("format")),
        each("HIGH", "S3-CAS-CHECKDIGIT", lambda: of_status("checkdigit")),
        each("MED", "S3-DUPLICATE-CAS", again),
        rows("MED", "S3-MISSING-CAS", lambda c: F.col("mixture") & ~F.exists(c["cas"], lambda x: x["status"] == "ok")),
        rows("CRIT", "S3-KATAKANA-SUBSTANCE", lambda c: _not_ja() & (_katakana(c["generic"]) | _katakana(c["iupac"]))),
        rows("HIGH", "S3-NAME-IS-CAS", lambda c: bare_cas(c["generic"]) | bare_cas(c["iupac"])),
        each("HIGH", "S3-MW-RANGE", lambda: F.transform(F.filter(weights(), lambda x: (x <= 0) | (x > 200_000)), lambda x: x.cast("string"))),
        rows("HIGH", "S3-DATE-IN-CONC", lambda c: c["conc"].rlike(r"\b(19|20|21)\d{2}-\d{2}-\d{2}\b")),
        rows("HIGH", "S3-YEAR-IN-CONC", lambda c: c["conc"].rlike(r"\b(19|20|21)\d{2}\b") & ~c["conc"].rlike(r"(19|20|21)\d{2}\s*[℃°]")),
        rows("MED", "S3-CONC-UNIT-NO-VALUE", lambda c: F.col("mixture") & c["unit"] & (F.size(c["values"]) == 0) & ~all_missing() & ~most_missing()),
        *_given(some, [
            ("HIGH", "S3-MIXTURE-ALL-CONC-MISSING", all_missing),
            ("HIGH", "S3-MAJORITY-CONC-MISSING", most_missing),
            ("MED", "S3-CONC-SUM-EXCEEDS", lambda: (F.size("values") > 1) & (total() > 102)),
            ("MED", "S3-SINGLE-NO-NAME", lambda: single() & _blank(F.concat(only()["generic"], only()["iupac"]))),
            ("MED", "S3-SINGLE-NO-CONC", lambda: single() & _blank(only()["conc"])),
        ]),
    ]


def section4() -> list[Rule]:
    route = lambda part: _field(f"FirstAidMeasures.ExposureRoute.FirstAid{part}")
    n = lambda: sum((~_blank(route(x))).cast("int") for x in ("Eye", "Ingestion", "Inhalation", "Skin"))
    text = lambda: _text("FirstAidMeasures")
    skin = lambda: F.when(route("Skin") != "", route("Skin")).otherwise(text())
    return _given(_always, [
        ("HIGH", "S4-NO-ROUTES", lambda: (n() == 0) & (_size(text()) > 10)),
        ("MED", "S4-FEW-ROUTES", lambda: _hazardous() & (n() < 2)),
        ("MED", "S4-NO-PHYSICIAN", lambda: _hazardous() & ~_has(text(), PHYSICIAN)),
        ("MED", "S4-EYE-HCODE-NO-EYE-AID", lambda: _codes(["H318", "H319", "H314"]) & _blank(route("Eye")) & ~_has(text(), EYE_WORDS)),
        *_keywords("FirstAidMeasures"),
        ("MED", "S4-H314-NO-REMOVE-CLOTHING", lambda: _codes(["H314"]) & ~_has(skin(), CLOTHING)),
    ])


def _section_of_words(level: str, number: int, section: str, least: int) -> list[Rule]:
    """A section that is empty below so many characters, and otherwise needs words."""
    empty = lambda: _size(_text(section)) < least
    return [Rule(level, f"S{number}-EMPTY", empty, f"S{number}-EMPTY"), *_given(lambda: ~empty(), _keywords(section))]


def section7() -> list[Rule]:
    storage = lambda: _field("HandlingAndStorage.Storage")
    absent = lambda: _blank(_field("HandlingAndStorage.SafeHandling")) & _blank(storage())
    return [
        Rule("HIGH", "S7-BOTH-ABSENT", absent, "S7-BOTH-ABSENT"),
        *_given(lambda: ~absent(), [
            *_keywords("HandlingAndStorage"),
            ("MED", "S7-FLAMMABLE-NO-STORAGE-TEMP", lambda: _codes(FLAMMABLE) & ~_has(storage(), DEGREES) & ~_has(storage(), COOL)),
        ]),
    ]


def section8() -> list[Rule]:
    at = "ExposureControlPersonalProtection"
    parts = ("EyeProtection", "HandProtection", "RespiratoryProtection", "SkinProtection", "BodyProtection")
    ppe = lambda part: _field(f"{at}.PersonalProtectionEquipment.{part}")
    n_ppe = lambda: sum((~_blank(ppe(x))).cast("int") for x in parts)
    controls = lambda: F.concat(_field(f"{at}.AppropriateEngineeringControls"), _field(f"{at}.EngineeringControls"))
    limits = lambda: F.concat(_field(f"{at}.OccupationalExposureLimits"), _field(f"{at}.OEL"))
    absent = lambda: _blank(controls()) & (n_ppe() == 0) & _blank(limits())
    return [
        Rule("HIGH", "S8-ALL-ABSENT", absent, "S8-ALL-ABSENT"),
        *_given(lambda: ~absent(), [
            ("MED", "S8-FEW-PPE-FIELDS", lambda: _hazardous() & (n_ppe() < 2)),
            ("MED", "S8-NO-ENG-CONTROLS", lambda: _hazardous() & _blank(controls()) & (n_ppe() > 0)),
            ("MED", "S8-NO-OEL", lambda: _hazardous() & ~F.col("mixture") & _blank(limits())),
            ("MED", "S8-OEL-NO-NUMERIC", lambda: ~_blank(limits()) & ~_has(limits(), OEL_NUMBER) & ~_has(limits(), OEL_NONE)),
            *_keywords(at),
            ("MED", "S8-SKIN-NO-GLOVE-MATERIAL", lambda: _codes(SKIN) & ~_blank(ppe("HandProtection")) & ~_has(ppe("HandProtection"), GLOVES)),
            ("MED", "S8-INHAL-NO-RESP-TYPE", lambda: _codes(INHALED) & ~_blank(ppe("RespiratoryProtection")) & ~_has(ppe("RespiratoryProtection"), RESPIRATORS)),
        ]),
    ]


def section9() -> list[Rule]:
    at = "PhysicalChemicalProperties"
    base = lambda part: _field(f"{at}.BasePhysicalChemicalProperties.{part}")
    raw = lambda part: F.col(f"r.{at}.{part}")
    text = lambda part: _field(f"{at}.{part}")
    either = lambda a, b: F.coalesce(raw(a), raw(b))
    density = lambda: either("Densities", "Density")
    density_text = lambda: F.trim(F.concat(F.coalesce(text_of(density()), F.lit("")), base("RelativeDensity")))
    flash, boiling = lambda: F.col("flash"), lambda: F.col("boiling")
    ignition = lambda pattern: F.filter("other", lambda x: _has(F.lower(x["name"]), pattern))
    auto_text = lambda: F.concat(text("AutoIgnitionTemperature"), F.array_join(F.transform(ignition(AUTO_IGNITION), lambda x: text_of(x["raw"])), ""))
    last = lambda: F.try_element_at(F.filter("other", lambda x: _has(F.lower(x["name"]), r"auto.ignit|自然発火|自燃|引火点")), F.lit(-1))
    auto = lambda: F.when(F.size(numbers(raw("AutoIgnitionTemperature"))) > 0, numbers(raw("AutoIgnitionTemperature"))).otherwise(numbers(last()["raw"]))
    ph_item = lambda: F.get(F.filter("other", lambda x: F.contains(F.lower(x["name"]), F.lit("ph"))), 0)
    ph_base = lambda: raw("BasePhysicalChemicalProperties.pH")
    outside = lambda c, lo, hi: ~c.between(lo, hi)
    ph = lambda: F.concat(numbers(ph_item()["raw"]), numbers(ph_base()))
    liquid = lambda: _has(base("PhysicalState"), "liquid|液")
    return [
        *_given(_always, [
            ("HIGH", "S9-NO-COLOUR-STATE", lambda: _blank(F.concat(base("Colour"), base("Appearance"))) & _blank(base("PhysicalState"))),
            ("MED", "S9-NO-ODOUR", lambda: _hazardous() & _blank(base("Odour"))),
            ("MED", "S9-NO-DENSITY", lambda: density_text().isin("", "情報なし", "N/A", "no data") & (F.size(numbers(density())) == 0)),
            ("MED", "S9-NO-WATER-SOL", lambda: _blank(text("Solubilities.WaterSolubility")) & ~_has(text("OtherPhysicalChemicalProperty"), SOLUBLE)),
            ("HIGH", "S9-FLASH-POINT-NOT-NUMERIC", lambda: flash().isNull() & ~_blank(text("FlashPoint")) & ~_has(text("FlashPoint"), NO_FLASH) & text("FlashPoint").rlike(r"[a-zA-Z\x{3040}-\x{30FF}]") & ~text("FlashPoint").rlike(r"(?U)\d")),
            ("MED", "S9-FLASH-POINT-RANGE", lambda: outside(flash(), -220, 400)),
            ("MED", "S9-FLAMMABLE-NO-FP", lambda: _codes(FLAMMABLE) & flash().isNull() & (F.size(items(raw("FlashPoint"))) == 0)),
            ("MED", "S9-H224-FP-TOO-HIGH", lambda: _codes(["H224"]) & (flash() >= 23)),
            ("MED", "S9-H226-FP-RANGE", lambda: _codes(["H226"]) & ~_codes(["H224", "H225"]) & ((flash() < 23) | (flash() >= 60))),
            ("MED", "S9-FP-GTE-BP", lambda: flash() >= boiling()),
            ("MED", "S9-BP-RANGE", lambda: outside(boiling(), -200, 3000)),
            ("MED", "S9-LIQUID-NO-BP", lambda: liquid() & (F.coalesce(boiling(), F.lit(0.0)) == 0) & _blank(text("BoilingPointRelated"))),
            ("MED", "S9-SOLID-NO-MP", lambda: _has(base("PhysicalState"), SOLID) & (F.size(numbers(raw("MeltingPointRelated"))) == 0) & _blank(text("MeltingPointRelated"))),
            ("MED", "S9-FLAMMABLE-NO-AUTOIGN", lambda: _codes(FLAMMABLE) & _blank(auto_text())),
            ("MED", "S9-AUTOIGN-BELOW-FP", lambda: F.coalesce(F.exists(auto(), lambda x: x < F.col("flash")), F.lit(False))),
            ("MED", "S9-NO-VAPOUR-PRESSURE", lambda: _codes([*FLAMMABLE, "H330", "H331", "H332"]) & _blank(F.coalesce(text_of(either("VapourPressure", "VaporPressure")), F.lit("")))),
        ]),
        Rule("MED", "S9-PH-RANGE", lambda: F.filter(ph(), lambda x: outside(x, 0, 14)), lambda x: F.concat(F.lit("pH "), x.cast("string")), each=True),
        *_given(_always, [
            ("MED", "S9-CORROSIVE-NO-PH", lambda: _codes(["H314", "H290"]) & ph_item().isNull() & ph_base().isNull()),
            ("MED", "S9-DENSITY-RANGE", lambda: F.exists(numbers(density()), lambda x: outside(x, 0.1, 25))),
        ]),
    ]


def section10() -> list[Rule]:
    text = lambda: _text("StabilityReactivity")
    return [
        *_section_of_words("MED", 10, "StabilityReactivity", 30),
        *_given(lambda: _size(text()) >= 30, [
            ("MED", "S10-NO-INCOMPATIBLE", lambda: _codes(REACTIVE) & _blank(_field("StabilityReactivity.IncompatibleMaterials")) & ~_has(text(), INCOMPATIBLE)),
            ("MED", "S10-NO-DECOMP-PRODUCTS", lambda: _codes(EXPLOSIVE) & _blank(_field("StabilityReactivity.HazardousDecompositionProducts"))),
        ]),
    ]


def section11() -> list[Rule]:
    text = lambda: _text("ToxicologicalInformation")
    # the first entry that has a field counts
    of = lambda name: F.coalesce(text_of(F.get(F.filter(F.transform("tox", lambda x: x[name]), lambda x: x.isNotNull()), 0)), F.lit(""))
    needs = [("S11-H315-NO-SCI", ["H315"], "SkinCorrosionIrritation"), ("S11-H319-NO-EDI", ["H318", "H319"], "EyeDamageOrIrritation"), ("S11-H334-NO-SENSITIZ", ["H334"], "Sensitization"),
             ("S11-H350-NO-CARC", ["H350", "H351"], "Carcinogenicity"), ("S11-H360-NO-REPTOX", ["H360", "H361"], "ReproductiveToxicity"), ("S11-H370-NO-STOT", ["H370", "H371", "H372", "H373"], "SpecificTargetOrgan")]
    empty = lambda: _size(text()) < 20
    return [
        Rule("HIGH", "S11-EMPTY", empty, "S11-EMPTY"),
        *_given(lambda: ~empty(), [
            ("MED", "S11-ACUTE-TOX-MISSING", lambda: _codes(ACUTE) & _blank(of("AcuteToxicity"))),
            ("MED", "S11-NO-LD50", lambda: _codes(ACUTE) & ~_blank(of("AcuteToxicity")) & ~_has(text(), LD50)),
            *(("MED", name, lambda c=codes, f=field: _codes(c) & _blank(of(f))) for name, codes, field in needs),
            ("MED", "S11-H350-NO-CARC-CLASS", lambda: _codes(["H350", "H351"]) & ~_blank(of("Carcinogenicity")) & ~_has(of("Carcinogenicity"), CARCINOGEN_CLASS)),
        ]),
    ]


def section12() -> list[Rule]:
    text = lambda: _text("EcologicalInformation")
    empty = lambda: _codes([*AQUATIC, "H420"]) & (_size(text()) < 20)
    log_p = lambda: F.exists("other", lambda x: _has(x["name"], LOG_P) & (F.size(numbers(x["raw"])) > 0))
    return [
        Rule("HIGH", "S12-ENV-HCODE-EMPTY", empty, "S12-ENV-HCODE-EMPTY"),
        *_given(lambda: ~empty(), [
            *_keywords("EcologicalInformation"),
            ("MED", "S12-NO-LOGP", lambda: _codes(AQUATIC) & ~_has(text(), LOG_P) & ~log_p()),
            ("MED", "S12-HAZARDOUS-EMPTY", lambda: _hazardous() & (_size(text()) < 20)),
        ]),
    ]


def section14() -> list[Rule]:
    text = lambda: _text("TransportInformation")
    missing = lambda: _size(text()) <= 10
    un = lambda: _has(text(), UN_NUMBER)
    tokens = lambda: F.regexp_extract_all(text(), F.lit(r"(?i)\b(UN[-\s]?\d+)\b"), F.lit(1))
    return [
        Rule("MED", "S14-MISSING", missing, "S14-MISSING"),
        *_given(lambda: ~missing(), [
            ("MED", "S14-DG-NO-UN", lambda: _codes(DANGEROUS_GOODS) & ~un() & ~_has(text(), NOT_REGULATED)),
            ("MED", "S14-UN-FORMAT", lambda: un() & F.exists(tokens(), lambda x: ~x.rlike(r"(?i)^UN\s?\d{4}$"))),
            ("MED", "S14-NO-PACKING-GROUP", lambda: un() & ~_has(text(), PACKING_GROUP)),
            ("MED", "S14-NO-SHIPPING-NAME", lambda: un() & ~_has(text(), SHIPPING_NAME)),
        ]),
    ]


def section15() -> list[Rule]:
    text = lambda: _text("RegulatoryInformation")
    ja = lambda: F.col("lang").eqNullSafe(F.lit("ja"))
    return [
        *_section_of_words("MED", 15, "RegulatoryInformation", 1),
        *_given(lambda: ~_blank(text()), [
            ("MED", "S15-JA-NO-JA-LAW", lambda: ja() & ~_has(text(), JA_LAW)),
            ("MED", "S15-ZHCN-NO-GB", lambda: (F.col("lang") == "zh-cn") & ~_has(text(), GB_STANDARD)),
            ("MED", "S15-JA-NO-PRTR", lambda: ja() & _codes(PRTR) & ~text().rlike("PRTR|化管法|化学物質管理促進")),
        ]),
    ]


_DATE = r"^\d{4}-\d{2}-\d{2}$"


def section16() -> list[Rule]:
    issued = lambda: _field("Datasheet.IssueDate")
    revised = lambda: F.filter(F.transform(items(F.col("r.Datasheet.RevisionDate")), F.trim), lambda x: x != "")
    other = lambda: F.regexp_extract_all(_text("OtherInformation"), F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    dates = lambda: F.concat(F.filter(F.array(issued()), lambda x: x != ""), revised(), other())
    year = lambda x: F.substring(x, 1, 4).cast("int")

    def problem(x: Column) -> Column:
        return F.when(~x.rlike(_DATE), "S16-DATE-FORMAT").when(~year(x).between(2000, 2030), "S16-DATE-YEAR-RANGE").when(year(x) < 2020, "S16-DATE-OLD")

    first = lambda: F.get(F.filter(F.transform(F.slice(dates(), 1, 3), problem), lambda x: x.isNotNull()), 0)
    return _given(_always, [
        ("MED", "S16-NO-DATE", lambda: F.size(dates()) == 0),
        *(("MED", name, lambda n=name: first().eqNullSafe(F.lit(n))) for name in ("S16-DATE-FORMAT", "S16-DATE-YEAR-RANGE", "S16-DATE-OLD")),
        ("HIGH", "S16-REVISION-BEFORE-ISSUE", lambda: issued().rlike(_DATE) & F.exists(revised(), lambda x: x.rlike(_DATE) & (x < issued()))),
    ])


def across(as_of_year: int) -> list[Rule]:
    populated = lambda: F.col("populated")

    def repeated() -> Column:
        """The later sections that have a long text of an earlier one, one entry each."""
        earlier = lambda e: F.exists("long", lambda o: (o["text"] == e["text"]) & (o["at"] < e["at"]))
        at = F.array_distinct(F.transform(F.filter("long", earlier), lambda e: e["at"]))
        return F.transform(at, lambda n: F.get(F.array(*map(F.lit, NUMBERED)), n))

    families = lambda: F.array_distinct(F.transform("h", lambda x: F.substring(x, 2, 1)))
    hiragana = lambda s: _text(s).rlike(r"[\x{3041}-\x{3096}]")
    return [
        *_given(_always, [
            ("HIGH", "CX-PLACEHOLDER", lambda: _has(F.coalesce("all_text", F.lit("")), PLACEHOLDER)),
            ("HIGH", "CX-FEW-SECTIONS-HIGH", lambda: populated() < 10),
            ("MED", "CX-FEW-SECTIONS-MED", lambda: populated().between(10, 12)),
            ("MED", "CX-H290-NO-ACID", lambda: _codes(["H290"]) & ~_has(_text("Composition"), ACIDS)),
            ("HIGH", "CX-JA-TEXT-IN-ZH-SDS", lambda: F.col("lang").isin("zh-cn", "zh-tw") & (hiragana("HazardIdentification") | hiragana("Composition"))),
        ]),
        Rule("MED", "CX-DUPLICATE-SECTION-TEXT", repeated, lambda s: F.concat(F.lit("text of an earlier section in "), s), each=True),
        *_given(_always, [
            ("MED", "CX-SINGLE-HCODE-FAMILY", lambda: F.col("mixture") & (F.size("components") > 3) & (F.size("h") >= 2) & (F.size(families()) == 1)),
            ("MED", "CROSS-STALE-DATE", lambda: F.lit(as_of_year) - F.substring(F.col("r.Datasheet.RevisionDate"), 1, 4).try_cast("int") > 5),
        ]),
    ]


def catalogue(as_of_year: int) -> dict[str, list[Rule]]:
    """All rules here by the section that they check, in order."""
    return {
        "S1": section1(), "S2": code_formats(), "S3": section3(), "S4": section4(),
        "S5": _section_of_words("HIGH", 5, "FireFightingMeasures", 15), "S6": _section_of_words("MED", 6, "AccidentalReleaseMeasures", 30),
        "S7": section7(), "S8": section8(), "S9": section9(), "S10": section10(), "S11": section11(), "S12": section12(),
        "S13": _section_of_words("MED", 13, "DisposalConsiderations", 1), "S14": section14(), "S15": section15(), "S16": section16(), "CX": across(as_of_year),
    }


def _long(strings: Column, at: int) -> Column:
    """The texts of over 100 characters of a section's strings, with its place."""
    return F.transform(F.filter(strings, lambda x: F.char_length(x) > 100), lambda x: F.struct(F.trim(x).alias("text"), F.lit(at).alias("at")))


def checked(records: DataFrame, as_of_year: int, sections: tuple[str, ...] | None = None) -> DataFrame:
    """``records`` (lang, record, ...) with ``findings`` in rule order; of ``sections``
    only, if given."""
    chosen = [r for name, rules in catalogue(as_of_year).items() if sections is None or name in sections for r in rules]
    read = facts(records, sections)
    if sections is None or "S3" in sections:
        read = with_parts(read)
    if sections is None or "CX" in sections:
        # the strings of a record stand in its text as they are, unless something is escaped there
        may = F.contains("whole", F.lit("\\")) | _has(F.col("whole"), PLACEHOLDER)
        read = read.withColumn("all_strings", F.when(may, F.array_join(leaves(F.col("record")), " "))).withColumn("all_text", normalized(F.col("all_strings")))
        read = read.withColumn("populated", sum((_size(_text(x)) > 10).cast("int") for x in NUMBERED))
        of = [_long(F.col(f"l_t_{x}"), n) for n, x in enumerate(NUMBERED)]
        read = read.withColumn("long", F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<struct<text:string,at:int>>")) for x in of))))
    return read.withColumn("findings", findings(chosen)).select(*records.columns, "findings")
