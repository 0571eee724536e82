"""Word lists and lookup tables of the triple cleaning rules.

Fixed values: they must equal the lists of the data they clean for right results.
Every operator takes another :class:`BookRules` for another book.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DEFAULT_CATEGORY = "其他"
DEFAULT_TYPE = "Person"
PLACE, TEXT, ITEM, PERSON = "Place", "Text", "Item", "Person"

# fixed values: type names and their canonical form
TYPE_MAP = {
    "Location": "Place", "Place": "Place", "Person": "Person", "Org": "Org", "Organization": "Org",
    "Item": "Item", "Object": "Item", "Event": "Event", "Text": "Text",
}

TEAM = "取经团队"
BUDDHIST = "佛门（灵山/观音体系）"
HEAVEN = "天庭（天宫/星宿/天兵天将）"
TAOIST = "道门仙家（三清/老君/洞天福地）"
UNDERWORLD = "地府冥界（十殿/鬼差）"
DRAGON = "龙宫水族（四海/水府）"
TANG = "人间大唐（朝廷）"
REALMS = "人间诸国（西域各国/地方政权）"
LOCAL_GODS = "地方神祇（土地/山神/城隍/河神）"
DEMONS = "妖魔势力（洞府妖王）"

# fixed values: the categories
CATEGORIES = (TEAM, BUDDHIST, HEAVEN, TAOIST, UNDERWORLD, DRAGON, TANG, REALMS, LOCAL_GODS, DEMONS, DEFAULT_CATEGORY)

# fixed values: exact aliases and the main name
ALIASES = {
    "悟空": "孙悟空", "行者": "孙悟空", "孙行者": "孙悟空", "齐天大圣": "孙悟空", "美猴王": "孙悟空", "弼马温": "孙悟空",
    "石猴": "孙悟空", "孙大圣": "孙悟空", "大圣": "孙悟空", "唐僧": "唐三藏", "三藏": "唐三藏", "玄奘": "唐三藏", "御弟": "唐三藏",
    "八戒": "猪八戒", "悟能": "猪八戒", "猪悟能": "猪八戒", "天蓬元帅": "猪八戒", "沙僧": "沙悟净", "悟净": "沙悟净",
    "沙和尚": "沙悟净", "白龙马": "小白龙", "观音": "观音菩萨", "观世音": "观音菩萨", "如来": "如来佛祖", "玉帝": "玉皇大帝",
    "玉皇大天尊": "玉皇大帝", "玉皇大天尊玄穹高上帝": "玉皇大帝", "老君": "太上老君", "太宗": "唐太宗", "八金刚": "八大金刚",
}

# fixed values: relation words and their standard form
RELATION_MAP = {
    "抵达": "到达", "送至东土": "送至", "奉佛旨送行": "送行", "奉命送行": "送行", "引往": "带往", "传旨封为": "封为", "奉命献上": "献上",
}

# fixed values: relation words of a question and the relation they ask for
QUESTION_WORDS = {
    "爸爸": "父亲", "妈妈": "母亲", "爸": "父亲", "妈": "母亲", "父亲": "父亲", "母亲": "母亲", "儿子": "儿子", "女儿": "女儿",
    "丫环": "丫环", "兄弟": "兄弟", "妻": "妻", "老婆": "妻", "哥哥": "哥哥", "表妹": "表兄妹", "弟弟": "弟弟", "妾": "妾",
    "养父": "养父", "姐姐": "姐姐", "娘": "母亲", "爹": "父亲", "father": "父亲", "mother": "母亲", "朋友": "朋友", "爷爷": "爷爷",
    "奶奶": "奶奶", "孙子": "孙子", "老公": "丈夫", "岳母": "岳母", "表兄妹": "表兄妹", "孙女": "孙女", "嫂子": "嫂子", "暧昧": "暧昧",
}

# fixed values: relations that say nothing
STOP_RELATIONS = (
    "相关", "有关", "提到", "出现", "认为", "知道", "看到", "说", "讲", "对话", "发生", "关系", "是", "为", "在", "有", "叫", "名为",
    "称为", "成为", "属于", "关于", "对", "向", "从", "把", "将", "给", "让",
)

# fixed values: pronouns and titles that name nobody
GENERIC_TITLES = (
    "他", "她", "它", "我们", "你们", "他们", "她们", "大家", "众人", "师父", "徒弟", "和尚", "法师", "国王", "太子", "公主", "老者",
    "大王", "小妖", "妖怪",
)

# fixed values: entities with a known category
FIXED_CATEGORY = {
    "孙悟空": TEAM, "唐三藏": TEAM, "猪八戒": TEAM, "沙悟净": TEAM, "小白龙": TEAM, "玉皇大帝": HEAVEN, "王母娘娘": HEAVEN,
    "托塔李天王": HEAVEN, "哪吒三太子": HEAVEN, "太白金星": HEAVEN, "二郎神": HEAVEN, "巨灵神": HEAVEN, "赤脚大仙": HEAVEN,
    "太上老君": TAOIST, "须菩提祖师": TAOIST, "菩提祖师": TAOIST, "秦广王": UNDERWORLD, "东海龙王敖广": DRAGON,
}

# fixed values: category by keyword, first rule that holds: (category, required type or None, pattern)
CATEGORY_RULES = (
    (BUDDHIST, None, "菩萨|佛祖|如来|罗汉|金刚|比丘|灵山"),
    (HEAVEN, None, "天庭|天宫|凌霄|瑶池|星君|天王|天兵|天将|仙女|玉皇"),
    (TAOIST, PERSON, "老君|真人|仙翁|道君|祖师"),
    (UNDERWORLD, None, "阎王|阎罗|冥|地府|鬼|判官|生死簿"),
    (DRAGON, None, "龙宫|龙王|龙子|龙女|水府|水族"),
    (LOCAL_GODS, None, "土地|山神|城隍|河神"),
    (DEMONS, None, "妖|怪|精|魔|.大王$"),
    (TANG, None, "唐王|大唐|长安|御弟"),
    (REALMS, None, "国王|太子|公主|郡王|王妃|将军|丞相"),
    (REALMS, PLACE, "国$|洲$|部洲"),
    (HEAVEN, PLACE, "瑶池|蟠桃园|蟠桃会|凌霄|天宫|天庭|兜率宫|老君宫|齐天大圣府"),
    (DRAGON, PLACE, "龙宫|东海|西海|南海|北海"),
    (UNDERWORLD, PLACE, "幽冥|地府"),
    (DEMONS, PLACE, "^(花果山|水帘洞)$"),
)

# fixed values: relations whose tail is a place
LOCATIVE = (
    "位于", "居住于", "前往", "到达", "进入", "抵达", "返回", "离开", "出发", "驻扎", "送至", "带往",
)
LOCATED_IN = "位于"

# fixed values: how a name looks like a type, in this order
TYPE_LOOKS = (
    (PLACE, "[山洞寺宫国城府岭河海塔关殿园观庙庄寨桥井州谷泉台馆楼峰]"),
    (TEXT, "[经书咒卷令符诏牒文旨檄表]"),
    (ITEM, "[棒刀剑杖锤珠铃环袍甲冠靴履扇鞭叉索网袋瓶葫芦炉钯]"),
    (PERSON, "(王|公|君|帝|佛|菩萨|罗汉|将军|天尊|祖师|星君|娘娘|大仙|真人|老君|太子|龙王)$"),
)

# fixed values: relations that hold a place after the last character, and the reduced relations
HELD_DOWN_AT = ("被镇压于", "封压于", "镇压于")
PASSIVE_HELD, HELD_BY = "被镇压于", "镇压"

# fixed values: the two servant relations and their direction (maid first)
SERVANT_RELATIONS = ("丫环", "丫头")

# fixed values: tail type by a word in the relation: (pattern, only if the tail is a person, type)
RELATION_TAIL_TYPES = (("居住|位于", False, "Location"), ("拥有|使用|赠与", True, "Item"), ("事件|参与|主导", False, "Event"))


@dataclass(frozen=True)
class BookRules:
    aliases: dict = field(default_factory=lambda: dict(ALIASES))
    relations: dict = field(default_factory=lambda: dict(RELATION_MAP))
    relation_synonyms: dict = field(default_factory=dict)
    types: dict = field(default_factory=lambda: dict(TYPE_MAP))
    categories: tuple = CATEGORIES
    fixed_category: dict = field(default_factory=lambda: dict(FIXED_CATEGORY))
    category_rules: tuple = CATEGORY_RULES
    stop_relations: tuple = STOP_RELATIONS
    generic_titles: tuple = GENERIC_TITLES
    locative: tuple = LOCATIVE
    type_looks: tuple = TYPE_LOOKS


JOURNEY = BookRules()
