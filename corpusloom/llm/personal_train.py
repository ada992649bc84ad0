"""Training of the model of problem 6: python -m corpusloom.llm.personal_train SECONDS TABLE... [--go-on]

Labelled spans come from carriers, wordings with a place for an item, filled at random with general or invented material, and set
between sentences of the tables (BACKGROUND of the texts of each at most are read), and from look-alikes: numbers and names of other things in
the same forms. No name, street, town or wording is taken from the test tables. Everything is seeded. --go-on starts from the stored weights.
"""

from __future__ import annotations

import random
import re
import string
import sys
import time
from concurrent.futures import ProcessPoolExecutor

import numpy as np

from corpusloom.llm.personal import TAGS, TYPES, VOCABULARY, WEIGHTS, read

BACKGROUND = 6000
STEPS, BATCH, EMBEDDING, HIDDEN, WORKERS = 128, 48, 32, 28, 8

#: Share of the new weights where training goes on from stored ones: their mean generalises better than either.
MEAN = 0.6

R = random.Random(7)
pick = R.choice


def digits(n: int) -> str:
    return "".join(R.choice(string.digits) for _ in range(n))


#: General material: frequent given names and surnames of many countries. Half of all names are invented by rule instead.
GIVEN = """James Mary John Linda Robert Susan Peter Anna Laura Thomas Emma David Julia Mark Nina Oscar Ruth Simon Clara Michael Jennifer William Patricia Daniel
Jessica Matthew Karen Andrew Nancy Joseph Lisa Kevin Sandra George Helen Edward Alice Henry Grace Arthur Rose Walter Ingrid Jürgen Heike Wolfgang Sabine Dieter
Giulia Marco Chiara Luca Pierre Camille Antoine Élodie Carlos Lucía Javier Carmen José María Diego Sofía Ahmed Fatima Omar Layla Hassan Yusuf Aisha Ravi Ananya
Arjun Deepa Sanjay Lakshmi Kenji Yuki Haruto Sakura Minh Linh Olga Dmitri Natasha Ivan Kwame Amara Chidi Björn Astrid Søren Freya Mateusz Katarzyna""".split()
FAMILY = """Smith Johnson Brown Clark Hall Baker Cooper Turner Walker Taylor Wilson Evans Roberts Wright Green Adams Nelson Carter Mitchell Phillips Campbell Murphy
Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schulz Rossi Russo Ferrari Esposito Martin Bernard Dubois Moreau Laurent García Rodríguez Martínez
López González Hernández Silva Santos Oliveira Khan Hussain Ali Patel Sharma Singh Gupta Reddy Iyer Tanaka Suzuki Watanabe Nguyen Tran Ivanov Petrov Kowalski Nowak
Okafor Mensah Andersson Larsen Nielsen O'Brien O'Connor McDonald MacLeod""".split()
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
GIVEN_ZH = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰文斌波辉鑫宇欣怡子涵浩然诗梦雨晨思远嘉宁若安清瑶建国红梅志海燕晓峰婷雪俊琳佳慧春生庆莉云飞天翔丹凤永亮德福贵荣世新立东少昌永康乐凯瑞泽轩睿萱彤瑾瑜昊苒煜"
ONSETS = "b br c ch cl cr d dr f fl fr g gl gr h j k kl l m n p ph pl pr qu r rh s sh sk sl st str t th tr v w wh y z".split()
VOWELS = "a e i o u a e i o ai au ea ee ei ie oa oo ou y".split()
CODAS = ["", "", "", *"l m n r s t d k ll nd ng nn rd rn rs rt ss st th x ck lm".split()]
ENDINGS = "wick ridge by holt stead more ton son sen ley man ford well ham berg ski sky er worth field wood ell ers ing ez es ini elli ov ova ev eau ault ard ner bach stein mann dottir nathan pillai murthy moto naka mura yama shvili yan oğlu".split()


def sound(parts: int) -> str:
    return "".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(parts))


def cap(parts: int) -> str:
    return sound(parts).capitalize()


def given() -> str:
    one = pick(GIVEN) if R.random() < 0.45 else cap(R.choice((1, 2, 2, 3)))[:11] + pick(["", "", "a", "el", "in", "is", "o", "ine", "ette"])
    return f"{one}-{pick(GIVEN)}" if R.random() < 0.03 else one


def family() -> str:
    if R.random() < 0.4:
        return pick(FAMILY)
    made = cap(R.choice((1, 1, 2)))[:9] + pick(ENDINGS) if R.random() < 0.7 else cap(2)[:12]
    return pick([made] * 12 + ["Mc" + made, "de " + made, "van " + made, f"{made}-{pick(FAMILY)}"])


def name() -> str:
    g, f = given(), family()
    title = pick(["Dr. ", "Dr ", "Mr. ", "Mr ", "Mrs. ", "Mrs ", "Ms. ", "Ms ", "Prof. ", "Professor ", "Miss "])
    return pick([f"{g} {f}"] * 5 + [f"{g} {pick(string.ascii_uppercase)}. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {given()} {f}"] + [f"{title}{f}"] * 3 + [f"{title}{g} {f}"] * 2)


def name_zh() -> str:
    surname = pick(SURNAMES) if R.random() < 0.96 else pick(["欧阳", "司马", "上官", "诸葛", "皇甫"])
    any_char = lambda: R.choice(GIVEN_ZH) if R.random() < 0.75 else chr(R.randrange(0x4E00, 0x9F00))
    return surname + "".join(any_char() for _ in range(pick([1, 2, 2, 2])))


def host() -> str:
    return pick([sound(2)[:10], sound(1) + pick("mail net corp lab uni desk soft data works bank".split()), f"{sound(1)}-{sound(1)}", *"mail corp lab uni notes office web post gmail outlook".split()])


def email() -> str:
    g, f = given().lower().replace(" ", ""), family().lower().replace(" ", "").replace("'", "")
    local = pick([f"{g}.{f}", f"{g}.{f}", f"{g}-{f}", f"{g}_{f}", f"{g}+{pick(['data', 'news', 'lab', 'shop'])}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g[0]}{f}_{digits(2)}", f"{f}_{digits(2)}", f"{f}{digits(2)}", f"{pick(['info', 'team', 'data', 'help', 'sales'])}.{f}", f, g, sound(2)])
    domain = pick(["", "", "", f"{sound(1)}."]) + host() + pick(".example .example.com .example.org .example.net .test .com .com .org .net .cn .com.cn .edu .edu.cn .co.uk .ac.uk .io .de .fr .in .gov .info".split())
    out = f"{local}@{domain}"
    kind = R.random()
    if kind < 0.16:
        sep = pick([" [at] ", " (at) ", " at ", "[at]", " AT ", "(at)"])
        dot = " [dot] " if "[" in sep else " (dot) " if "(" in sep else " dot "
        return f"{local}{sep}{domain.replace('.', dot) if R.random() < 0.85 else domain}"
    if kind < 0.26:
        return f"<mailto:{out}>"
    return out.upper() if kind < 0.34 else out


def phone() -> str:
    a, b, c = pick("201 212 303 312 415 512 617 702".split() + [digits(3)]), pick(["555", digits(3)]), digits(4)
    s, t = pick("-. "), pick("-. ")
    us = pick([f"({a}) {b}{s}{c}", f"({a}){b}-{c}", f"{a}{s}{b}{t}{c}", f"{a}-{b}-{c}", f"+1 {a}{s}{b}{t}{c}", f"+1 ({a}) {b}-{c}", f"tel:+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}"]) + pick([""] * 3 + [f" ext. {digits(2)}", f" ext. {digits(3)}", f" x{digits(3)}"])
    m = f"1{pick('3456789')}{digits(1)}"
    x, y = pick(["0000", digits(4)]), digits(4)
    cn = pick([f"{m}{s}{x}{s}{y}", f"{m}-{x}-{y}", f"{m} {x} {y}", f"{m}{x}{y}", f"+86 {m}{x}{y}", f"+86-{m} {x} {y}", f"+86 {m} {x} {y}", f"+86{m}{x}{y}", f"86-{m}-{x}-{y}", f"(+86) {m} {x} {y}", f"0{digits(2)}-{digits(8)}", f"0{digits(3)}-{digits(7)}", f"010-{digits(4)}-{digits(4)}"])
    cc = pick("44 49 33 39 34 91 81 61 31 46 7 55 52".split())
    more = pick([f"+44 20 7946 0{digits(3)}", f"020 7946 0{digits(3)}", f"+44 20 {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(4)} {digits(6)}", f"+{cc} {digits(2)} {digits(4)} {digits(4)}", f"+{cc} {digits(3)} {digits(7)}", f"+{cc} {digits(2)} {digits(7)}", f"+{cc}-{digits(2)}-{digits(4)}-{digits(4)}", f"+{cc} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{cc}{digits(10)}", f"00{cc} {digits(3)} {digits(6)}"])
    return pick([us, us, cn, cn, more])


def identity() -> tuple[str, str]:
    """What stands before a number, and the number."""
    y = f"{pick(['19', '20'])}{digits(2)}{R.randint(1, 12):02d}{R.randint(1, 28):02d}"
    region, tail = pick(["99" + digits(4), pick("123456") + digits(5)]), digits(3) + pick("0123456789X")
    cn = pick([region + y + tail] * 2 + [f"{region} {y} {tail}", f"{region}-{y}-{tail}"])
    s = pick("- -")
    ssn = f"{digits(3)}{s}{digits(2)}{s}{digits(4)}"
    ni = pick(["{} {} {} {} {}", "{}{}{}{}{}"]).format(pick("AB CE JK QQ PW".split()), digits(2), digits(2), digits(2), pick("ABCD"))
    passport = pick(string.ascii_uppercase) + digits(8)
    before = pick(["", "", "number ", "no. ", "No ", "# "])
    return pick([(pick(["SSN ", "SSN: ", "social security number ", "social security no. "]), ssn), ("", ssn), (pick(["national ID ", "ID card ", "identity card ", "citizen ID "]) + before, cn), ("", cn), ("", ni), (pick(["NI number ", "National Insurance number "]), ni), (pick(["passport ", "Passport ", "travel document "]) + before, passport), (pick(["passport ", "passport no. "]), passport)])


def identity_zh() -> tuple[str, str]:
    before, number = identity()
    return (pick(["护照号", "护照号码", "护照：", "护照"]), number) if number[0].isalpha() and number[1:].isdigit() else ("", number)


STREETS = "Street St. St Road Rd Rd. Avenue Ave Ave. Close Terrace Lane Ln Drive Dr Court Place Square Way Crescent Boulevard Blvd Grove Hill".split()
STEMS = "Oak Maple Cedar Elm Pine Church Mill Station Park High Main King Queen Victoria Albert Green North South West Bridge Castle River Lake Garden School Market Chapel Abbey Windmill Orchard".split()


def street() -> str:
    stem = pick(STEMS) + pick(["", "", "'s", "field", "s"]) if R.random() < 0.45 else cap(pick([1, 2, 2]))[:10] + pick(["", "", "field", "moor", "gate", "mere", "side", "wick", "ley", "bury", "by"])
    return f"{pick([''] * 8 + ['Old ', 'New ', 'East ', 'St. '])}{stem} {pick(STREETS)}"


def town() -> str:
    return pick("London Leeds Boston Austin Denver Dublin Oxford Bristol Chicago Portland".split()) if R.random() < 0.3 else cap(pick([1, 2]))[:9] + pick(["", "ton", "mouth", "beck", "worth", "ville", "burgh", "ham", "stow", "field"])


def address() -> str:
    n = str(R.randint(1, 2999)) if R.random() < 0.3 else str(R.randint(1, 250))
    n += pick([""] * 9 + ["A", "b"])
    flat, apt = f"{pick(['Flat', 'Unit', 'Apartment', 'Suite'])} {R.randint(1, 60)}, ", f", {pick(['Apt', 'Apt.', 'Unit', 'Suite', 'Flat'])} {R.randint(1, 90)}{pick(['', 'B', ''])}"
    return pick(["", "", "", flat]) + f"{n} {street()}" + pick(["", "", "", apt]) + pick(["", "", f", {town()}", f", {town()}", f", {town()} {digits(5)}"])


PLACES_ZH = "东南西北青白长安云海江山金银龙凤石松柏桃柳梅兰竹菊清平永新古大上下中华春秋明阳临广福德和泰兴盛文武"
STREET_ZH = ("人民", "中山", "建设", "长安", "和平", "东风", "解放", "南京西", "北京", "复兴", "延安", "淮海", "朝阳", "滨江", "学院", "科技")


def some_zh(n: int) -> str:
    return "".join(R.choice(PLACES_ZH) if R.random() < 0.6 else chr(R.randrange(0x4E00, 0x9F00)) for _ in range(n))


def street_zh() -> str:
    return (pick(STREET_ZH) if R.random() < 0.3 else some_zh(pick([2, 2, 2, 3]))) + pick(["路", "街", "大道", "巷", "大街", "胡同", "弄"])


def address_zh() -> str:
    city = pick(["", "", some_zh(2) + pick("市县区镇"), some_zh(2) + "市" + some_zh(2) + "区", some_zh(2) + "省" + some_zh(2) + "市"])
    return f"{city}{street_zh()}{R.randint(1, 2500)}号" + pick(["", "", f"{R.randint(1, 30)}栋{R.randint(1, 2500)}室", f"{R.randint(1, 30)}号楼{R.randint(1, 40)}0{R.randint(1, 9)}室", f"{R.randint(1, 9)}单元{digits(3)}室", f"{R.randint(2, 40)}层"])


#: Carriers: {} is the item's place. General wordings; half of all carriers are made of other words by carrier().
CARRIERS = {
    "email": ("Write to {} for details.", "Contact: {}", "email={}", "You can reach the team at {}.", "Please email {} today.", "邮箱：{}。", "请发邮件到{}。", "电子邮件 {}，欢迎来信。", "Sent from {} yesterday.", "Questions? {}", "来信请寄{}。", "cc {} and wait.", "{} asked for a refund.", "我的邮箱是{}，请查收。", "用户{}已注册。"),
    "phone": ("Call {} for help.", "Phone: {}.", "Our number is {} until six.", "Ring {} after noon.", "Fax: {}.", "Text {} when it is done.", "Mobile {}", "请拨打{}咨询。", "联系电话：{}，全天有效。", "电话{}。", "手机号是{}，请勿外传。", "如有疑问请致电{}。", "客服热线{}", "I left a message on {}.", "tel {}"),
    "street_address": ("Address: {}", "The office moved to {} in May.", "Parcels were sent to {}.", "We met at {} on Monday.", "She lives at {}.", "The office at {} is closed.", "Deliver it to {}.", "Invoice to {};", "They opened a shop at {} last year.", "located at {}"),
    "address_zh": ("地址：{}。", "办公室在{}，周末休息。", "包裹寄到{}。", "住址：{}。", "他住在{}。", "收货地址{}，请核对。", "公司搬到了{}。", "我们在{}见面。", "位于{}的门店"),
    "person_name": ("Dear {},", "Dear {}, thank you for your letter.", "Signed, {}", "Signed by {}.", "An interview with {}, teacher.", "My colleague {} has the key.", "The text was checked by {} last week.", "{}'s notebook is missing.", "The desk of {} is empty.", "{} wrote the summary.", "Thanks to {} for the review.", "We asked {} about it.", "according to {} it failed", "{} and the others left early.", "Author: {}", "Best regards, {}", "I met {} in the library.", "{} said nothing.",
                    "{} keeps the minutes.", "The phone of {} rang twice.", "The report of {} still lacks a date.", "Notes by {} survive.", "My neighbour {} has a spare.", "Our manager {} signed it.", "Photo: {}", "Yours sincerely,\n{}", "Hello {},",
                    "Hi {}, are you there?", "Translated by {}", "It was {} who found it.", "Please ask {} before noon.", "{}, the librarian, agreed.", "A talk with {}, engineer.", "The house of {} still stands.", "The bicycle of {} was stolen.", "Speaker: {}",
                    "Patient {} was admitted.", "cc: {}", "Regards,\n{}", "{} (born 1970)", "{} lives next door.", "Car of {} still blocks the gate.", "the uncle of {} came too", "My friend {} keeps bees.", "Our teacher {} owns one.", "To {}: come home.", "{} - owner"),
    "person_zh": ("联系人：{}。", "文稿由{}审阅。", "{}老师带来了样本。", "{}老师很忙。", "{}先生已签收。", "请转告{}女士。", "负责人{}昨天离开。", "由{}整理。", "作者：{}；", "{}博士说明了原因。", "签名：{}", "我和{}一起去。", "{}说他不知道。", "感谢{}的帮助。", "本文译者{}。", "{}经理批准了申请。",
                  "记者{}报道。", "{}医生", "{}教授讲了两个小时。", "{}同学迟到了。", "{}工程师说明了原因。", "译文经{}核对。", "此件由{}保管。", "{}保存了原件。", "{}女士来电。", "患者{}已出院。", "本页由{}录入。", "编辑：{}", "{}主任", "{}留下了便条。", "这段话由{}翻译。", "致{}："),
    "identity_number": ("The file of {}.", "The form shows {} at the bottom.", "Someone wrote {} on the ticket.", "He holds {}.", "On file: {}.", "Her card says {}, issued late.", "Record {};", "verified with {}"),
    "identity_zh": ("身份证：{}。", "登记的身份证号是{}。", "证件号码{}已核对。", "身份证号 {}，请保密。", "他的证件是{}。", "公民身份号码：{}；", "证件{}"),
}
LABELS = {
    "email": "mail email e-mail contact inbox reply-to sender owner user 邮箱 邮件 信箱 联系邮箱", "phone": "phone tel mobile cell hotline call desk number 电话 手机 热线 联系方式 来电 拨打",
    "street_address": "address office home site shop depot", "address_zh": "地址 住址 办公地址 收件地址 寄往 位于 搬至", "person_name": "author editor reviewer signed contact manager by from owner speaker",
    "person_zh": "作者 编辑 联系人 校对 审核 签名 主讲 记录人 负责人", "identity_number": "record form row file card document entry", "identity_zh": "身份证 证件号 身份证号码 登记号 证件",
}
WORDS = "the a of to and in was for on that with from has had were is not this by after before when then still again last week year file list note copy report room team work plan test draft page letter line part data over under first second".split()
WORDS_ZH = "的 了 在 和 是 我们 他们 这个 那份 文件 数据 报告 昨天 今天 已经 没有 之后 请 把 由 向 从 给 到 记录 样本 资料 会议 部门 保留 整理 提交".split()


def carrier(kind: str) -> tuple[str, str]:
    """What stands before and after an item: a carrier, or a label or some words in no order."""
    roll = R.random()
    if roll < 0.4:
        a, _, b = pick(CARRIERS[kind]).partition("{}")
        return a, b
    zh = kind.endswith("zh") or kind in ("email", "phone") and R.random() < 0.4
    lists = (WORDS_ZH, EVERYDAY_ZH, LINKS_ZH) if zh else (WORDS, EVERYDAY, VERBS)  # the words that everyday() has without an item
    some = lambda n: ("" if zh else " ").join(R.choice(R.choice(lists)) for _ in range(n))
    if roll < 0.6:
        label = pick(LABELS[kind].split())
        zh = label[0] > "⺀"
        label = label if zh or R.random() < 0.5 else label.capitalize()
        return label + pick(["：", ":", "", " "] if zh else [": ", "=", " ", " is ", " - "]), pick(["。", "，", "；", "\n", "，请" + some(1)] if zh else ["", ".", ";", "\n", ", " + some(3) + "."])
    before, after = some(R.randint(0, 5)), some(R.randint(0, 6))
    return before.capitalize() + ("" if zh or not before else " "), ("" if zh or not after else " ") + after + pick(["。", "，"] if zh else [".", ".", ";", ""])


def item(kind: str) -> tuple[str, str, str]:
    """(type, text before within the carrier, the item)."""
    if kind == "identity_number":
        return kind, *identity()
    if kind == "identity_zh":
        return "identity_number", *identity_zh()
    made = {"email": email, "phone": phone, "person_name": name, "person_zh": name_zh, "street_address": address, "address_zh": address_zh}[kind]()
    return {"person_zh": "person_name", "address_zh": "street_address"}.get(kind, kind), "", made


THINGS = "dataset toolkit benchmark parser index suite corpus archive ledger tokenizer model library notes set board loader framework protocol algorithm theorem compiler pipeline".split()
MONTHS = "January February March April May June July August September October November December Monday Tuesday Friday Sunday".split()


def look_alike() -> str:
    """A sentence with something that only resembles personal information."""
    w, n = sound(1), R.randint(2, 99)
    place = cap(pick([1, 2]))[:9] + pick(["", *ENDINGS[:24]])
    thing = pick(THINGS)
    number = pick([digits(n) for n in (6, 8, 10, 11, 12, 13, 14, 16, 17, 18, 18, 19, 20, 22)])
    return pick([
        f"The {street()} {pick(['subset', 'sample', 'station', 'exit', 'line', 'area'])} has {n} {pick(WORDS)}s.", f"{street()} is {pick(['closed', 'noisy', 'long', 'being repaired'])}.", f"we walked along {street()} {pick(['for an hour', 'twice', 'at night'])}",
        f"The decorator @{w}.{sound(1)} wraps {sound(1)}@{pick(['node', 'host', 'v'])}{n} calls.", f"npm install @{w}/{sound(1)}@{n}.{n}.0", f"@{sound(2)} replied",
        f"{pick(['Checksum', 'hash', 'digest', 'sha'])} {pick('13 15 154 18'.split())}{digits(pick([9, 10, 14, 16]))}{pick(['', pick('abcdef') + digits(pick([1, 3, 4]))])} {pick(['matches', 'differs', 'is stale'])};",
        f"Part {digits(pick([3, 4]))}-{digits(2)}-{digits(pick([3, 4, 5]))} replaces part {digits(5)}-{digits(2)}.", f"{pick(['Run', 'Job', 'Build', 'Batch', 'Step'])} {number} used {n},{digits(3)},{digits(3)} tokens.",
        f"版本号 {R.randint(1, 9)}.{n}.{R.randint(0, 9)}，{pick(['订单', '流水', '批次', '编号'])} {number} 已归档。", f"{pick(['订单号', '流水号', '快递单号', '序列号', '批次', '编号'])}{pick(['', '：', ' '])}{number}{pick(['已发货', '已完成', '。', '，待处理'])}。",
        f"{pick(['order', 'order no.', 'Order', 'invoice', 'ticket', 'tracking number', 'serial', 'case', 'batch', 'id', 'block', 'limit', 'offset'])} {number}{pick(['.', ' is closed.', ' was shipped', ';', ' failed', ''])}",
        f"{pick(['Grid', 'Address', 'host', 'Version', 'ratio'])} {digits(2)}.{digits(3)}.{digits(3)}{pick(['', '.' + digits(2)])} and ratio {digits(3)}:{digits(2)}:{digits(2)}.", f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"doi 10.{digits(4)}/{digits(7)}",
        f"{pick(['Release', 'Version', 'Build'])} {R.randint(1, 9)}.{n}.{digits(2)} came out on 20{digits(2)}-0{R.randint(1, 9)}-{R.randint(10, 28)}{pick(['', ' at 10:' + digits(2)])}.",
        f"{pick(['When', 'As', 'If', 'Before'])} {place} {pick(['', '', cap(2) + ' '])}{thing.capitalize()} grew to {digits(4)} tokens, it stopped.", f"The {family()} {thing} was rebuilt.", f"the {place} {thing} and the {cap(2)} {pick(THINGS).capitalize()}", f"{place} {pick(THINGS).capitalize()} {pick(['beats', 'extends', 'replaces', 'ships with'])} {cap(2)}.",
        f"Load {place} with {digits(4)} rows.", f"{place} {pick(['v', 'version '])}{n} is out", f"{pick(MONTHS)} {n} {pick(['and', 'to', 'until'])} {pick(MONTHS)}", f"{street_zh()}{pick(['数据集', '子集', '站', '样本'])}有{n}个样本。", f"{street_zh()}上没有{pick(['机房', '车站', '人'])}。", f"他们沿着{street_zh()}走了{n}分钟。",
        f"{place} {pick(['语料', '索引', '模型', '工具'])}增长到 {digits(4)}行以后，{pick(['评分器', '解析器', '过滤器', '加载器'])}开始复制窗口。", f"{pick(SURNAMES)}{pick(['体', '氏', '姓', '国', '色', '度', '级', '家'])}{pick(['算法', '模型', '数据', '方法'])}", f"{some_zh(2)}{pick(['模型', '算法', '工具', '平台', '大学', '公司'])}发布了第{n}版。",
        f"serial {pick('KEGD')}{digits(pick([5, 6]))}-{digits(pick([3, 4]))} passed.", f"id={digits(8)}; shard={digits(3)}", f"{pick(['model', 'part', 'flight', 'room', 'route'])} {pick(string.ascii_uppercase)}{digits(pick([3, 4, 5]))}", f"at {digits(2)}:{digits(2)} the {w} {pick(['hash', 'count', 'key'])} was {digits(6)}{pick('abcdef')}{digits(6)}.",
        f"{n} {pick(WORDS)} {pick(['roads', 'streets', 'avenues', 'lanes', 'hills'])} and {n} {thing}s", f"第{n}号{pick(['样本', '文件', '窗口', '楼', '机'])}，共{n}路{pick(['信号', '数据', '视频'])}。", f"x{n} = {digits(3)}.{digits(4)} + {digits(3)} - {digits(2)}", f"{cap(2)} {pick(['in', 'of', 'and'])} {cap(2)}: {pick(['a survey', 'an overview', 'notes'])}",
    ])


#: Everyday words of both languages; sentences of them hold no personal information.
EVERYDAY = """time year people way day man thing woman life child world school state family student group country problem hand place case week company system program question government number night point home water room mother area
money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea kid body information back parent
face level office door health person art war history party result change morning reason research girl guy moment air teacher force education""".split()
VERBS = "is was has made took went saw came found gave told felt became left put meant kept let began seemed helped showed heard played ran moved lived held brought wrote stood lost paid met included continued set learned changed led understood watched followed stopped".split()
EVERYDAY_ZH = """时间 问题 工作 学生 老人 孩子 城市 学校 医院 公司 市场 天气 春天 夏天 秋天 冬天 上午 下午 晚上 今年 去年 明年 昨天 今天 明天 方法 原因 结果 价格 质量 速度 温度 道路 车辆 火车 飞机 手表 衣服 水果 苹果 桃树 李花 米饭 牛奶 咖啡 房间 楼层 窗户 桌子
电脑 手机 软件 系统 程序 代码 函数 变量 数据库 网络 文章 书本 报纸 新闻 电影 音乐 节目 比赛 球队 历史 文化 经济 社会 国家 政府 法律 合同 会议 计划 任务 项目 客户 产品 商店 超市 公园 河流 山谷 江水 海洋 森林 田野 花草 白云 黄土 金属 石头 马路 牛羊 鱼群 鸟儿
师生 工人 农民 司机 店员 保安 记者 律师 护士 专家 观众 居民 游客 同事 朋友 邻居 家长 大家 我们 他们 你们 自己 别人 张开 周围 周期 高度 高速 方向 方程 程度 金额 万一 江南 石油 汤圆 常常 黎明 武器 任何 何时 何处 严重 夏季 秋季 温暖 温和 安全 安静 康复 平均 和谐 明亮 清晨 文明""".split()
LINKS_ZH = "的 了 在 和 是 把 被 给 对 从 向 已经 没有 可以 应该 需要 正在 开始 继续 发现 认为 觉得 喜欢 希望 决定 提高 降低 增加 减少 改变 保护 研究 完成 检查 修理 使用 购买 参加 离开 到达 经过 因为 所以 但是 如果 虽然 而且 或者 非常 十分 比较 都 也 还 就 才 又".split()


def everyday() -> str:
    """A sentence of everyday words in no particular sense, now and then with a number or an invented proper noun that is no person's."""
    if R.random() < 0.6:
        words = [R.choice(EVERYDAY_ZH if R.random() < 0.55 else LINKS_ZH) for _ in range(R.randint(3, 12))]
        if R.random() < 0.3:
            words.insert(R.randrange(len(words)), pick([digits(pick([1, 2, 4])), f"{digits(pick([1, 2, 4]))}{pick(list('元个条次度秒天米号层'))}", f"第{pick('一二三四五六七八九十')}{pick('章节页次层')}", f"{pick(string.ascii_uppercase)}{digits(pick([3, 8, 12]))}"]))
        return "".join(words) + pick(["。", "，", "！", "？", "；"])
    words = [R.choice(EVERYDAY if R.random() < 0.4 else VERBS if R.random() < 0.4 else WORDS) for _ in range(R.randint(3, 11))]
    if R.random() < 0.35:
        made = pick([cap(1) + cap(1), cap(2), sound(1).upper(), pick(EVERYDAY).capitalize()])
        words.insert(R.randrange(len(words)), pick([f"{made} {pick([*THINGS, *EVERYDAY]).capitalize()}", f"the {made} {pick([*THINGS, *EVERYDAY]).capitalize()}", digits(pick([2, 4, 8])), f"{digits(pick([1, 3]))},{digits(3)}", f"{pick(MONTHS)} {digits(2)}"]))
    return " ".join(words).capitalize() + "." if R.random() < 0.3 else (x := " ".join(words))[:1].upper() + x[1:] + pick([".", "?", ";"])


def background(*paths: str) -> list[str]:
    """Sentences of the tables, of BACKGROUND texts of each at most, as what is no personal information: none with an address sign, long numbers, two
    capitalised words in a row or a capitalised word beside a title; look-alikes are made anew."""
    import duckdb

    rows = [r for p in paths for r in duckdb.sql(f"SELECT DISTINCT text FROM '{p}' WHERE text IS NOT NULL ORDER BY hash(text) LIMIT {BACKGROUND}").fetchall()]
    marks = re.compile(r"@|\bat\]|\d{6}|\d[-. ]\d{3}|[A-Z][\w'-]*[.,]? +[A-Z][a-z]|[A-Z]\. [A-Z]|\b(Mr|Ms|Mrs|Dr|Prof)\b|联系人|校对|老师|先生|女士|身份证|护照|电话|邮箱|地址|passport|号")
    out = []
    for (t,) in rows:
        before = ""
        for s in re.split(r"(?<=[.;!?])\s+|(?<=[。；！？])|\n", t):  # what follows a title or an initial is half a sentence
            if 8 < len(s) < 400 and not marks.search(s) and not re.search(r"\b(Mr|Ms|Mrs|Dr|Prof|[A-Z])\.$", before):
                out.append(s)
            before = s
    return out


def noisy(sentence: str) -> str:
    """Letter case changed as a copy's formatting changes it, or odd words: capitals alone make no name."""
    kind = R.random()
    if kind < 0.62:
        return sentence
    if kind < 0.7:
        return sentence.upper()
    if kind < 0.78:
        return sentence.title()
    if kind < 0.84:
        return " ".join(R.choice((str.upper, str.lower, str.capitalize))(x) for x in sentence.split(" "))
    words = [sound(2)[:7] + pick(["ic", "ate", "ian", "ex", "il", "or", "um", "oss"]) for _ in range(R.randint(2, 7))]
    odd = " ".join(f"{x} {y}" for x, y in zip(words, sentence.split(" "), strict=False))
    return R.choice((str.lower, str.capitalize, str.title, str.upper, str.swapcase))(odd) + pick([".", "?", ",", ""])


WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(48, 123) if chr(c).isalnum()})


def example(sentences: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    text, marks = "", []
    for _ in range(R.randint(1, 6)):
        roll = R.random()
        if roll < 0.42:
            kind = pick([*CARRIERS, "person_name", "person_name", "person_zh"])
            label, before, made = item(kind)
            a, b = carrier(kind)
            if R.random() < 0.03:
                made = made.translate(WIDE)
            start = len(text) + len(a) + len(before)
            if made.startswith("<mailto:"):
                marks.append((start + 8, start + len(made) - 1, label))
            else:
                marks.append((start, start + len(made), label))
            text += a + before + made + b
        elif roll < 0.58:
            text += look_alike()
        elif roll < 0.70:
            text += everyday()
        else:
            text += noisy(pick(sentences))
        text += pick([" ", " ", " ", "\n", ""])
    return text, marks


def encoded(sentences: list[str], total: int) -> tuple[np.ndarray, np.ndarray]:
    """A stream of ids and tags, texts parted by padding."""
    ids, tags, n = [], [], 0
    while n < total:
        text, marks = example(sentences)
        own, places = read(text)
        tag = np.zeros(len(text), np.int64)
        for a, b, label in marks:
            k = TYPES.index(label)
            tag[a:b], tag[a] = 2 + 2 * k, 1 + 2 * k
        pad = R.randint(1, 40)
        ids += [own, np.zeros(pad, np.int64)]
        tags += [tag[places], np.zeros(pad, np.int64)]
        n += len(own) + pad
    return np.concatenate(ids), np.concatenate(tags)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of a sequence (steps, batch, inputs). Gates: input, forget, output, new content."""
    steps, n, h = len(x), x.shape[1], wh.shape[0]
    pre = x @ wx + b
    state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    outs, gates, cells = np.empty((steps, n, h), np.float32), np.empty((steps, n, 4 * h), np.float32), np.empty((steps + 1, n, h), np.float32)
    cells[0] = cell
    for t in range(steps):
        z = pre[t] + state @ wh
        z[:, : 3 * h] = sigmoid(z[:, : 3 * h])
        z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
        state = z[:, 2 * h : 3 * h] * np.tanh(cell)
        gates[t], cells[t + 1], outs[t] = z, cell, state
    return outs, (x, gates, cells, outs)


def lstm_back(d: np.ndarray, kept: tuple, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, gates, cells, outs = kept
    steps, n, h = d.shape
    dz = np.empty((steps, n, 4 * h), np.float32)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + d[t]
        i, f, o, g = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
        th = np.tanh(cells[t + 1])
        dc = dc + dh * o * (1 - th * th)
        dz[t, :, :h] = dc * g * i * (1 - i)
        dz[t, :, h : 2 * h] = dc * cells[t] * f * (1 - f)
        dz[t, :, 2 * h : 3 * h] = dh * th * o * (1 - o)
        dz[t, :, 3 * h :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = dz[t] @ wh.T
    flat = dz.reshape(-1, 4 * h)
    before = np.concatenate((np.zeros((1, n, h), np.float32), outs[:-1])).reshape(-1, h)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, before.T @ flat, flat.sum(0)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf(scores: np.ndarray, tags: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log likelihood a step and its gradients by forward and backward sums."""
    steps, n, k = scores.shape
    forward = np.empty_like(scores)
    forward[0] = scores[0] + s
    for t in range(1, steps):
        forward[t] = log_sum(forward[t - 1][:, :, None] + a, 1) + scores[t]
    total = log_sum(forward[-1], 1)
    backward = np.zeros_like(scores)
    da = np.zeros_like(a)
    for t in range(steps - 1, 0, -1):
        ahead = scores[t] + backward[t]
        both = a + ahead[:, None, :]
        da += np.exp(forward[t - 1][:, :, None] + both - total[:, None, None]).sum(0)
        backward[t - 1] = log_sum(both, 2)
    ds = np.exp(forward + backward - total[None, :, None])
    rows, cols = np.arange(steps)[:, None], np.arange(n)[None]
    truth = scores[rows, cols, tags].sum() + s[tags[0]].sum() + a[tags[:-1], tags[1:]].sum()
    loss = float(total.sum() - truth)
    ds[rows, cols, tags] -= 1
    np.add.at(da, (tags[:-1], tags[1:]), -1)
    return loss / (steps * n), ds / (steps * n), da / (steps * n), ds[0].sum(0) / (steps * n)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
    """The loss of a batch (steps, sequences) and its gradients."""
    d, h, k = EMBEDDING, w["f_wh"].shape[0], len(TAGS)
    e = w["e"][x]
    f, f_kept = lstm(e, w["f_wx"], w["f_wh"], w["f_b"])
    b, b_kept = lstm(e[::-1], w["b_wx"], w["b_wh"], w["b_b"])
    states = np.concatenate((f, b[::-1]), 2)
    keep = (rng.random(states.shape[1:]) < 0.9).astype(np.float32) / 0.9
    states = states * keep
    loss, ds, da, dstart = crf(states @ w["wo"] + w["bo"], y, w["a"], w["s"])
    flat = ds.reshape(-1, k)
    g = {"wo": states.reshape(-1, 2 * h).T @ flat, "bo": flat.sum(0), "a": da, "s": dstart, "e": np.zeros_like(w["e"])}
    dstates = (ds @ w["wo"].T) * keep
    dx, g["f_wx"], g["f_wh"], g["f_b"] = lstm_back(dstates[:, :, :h], f_kept, w["f_wx"], w["f_wh"])
    dy, g["b_wx"], g["b_wh"], g["b_b"] = lstm_back(dstates[::-1, :, h:], b_kept, w["b_wx"], w["b_wh"])
    np.add.at(g["e"], x.ravel(), (dx + dy[::-1]).reshape(-1, d))
    return loss, g


_STREAM: list[np.ndarray] = []


def _prepare(paths: list[str], size: int, seed: int) -> None:
    """A worker's own stream of examples."""
    R.seed(seed)
    _STREAM[:] = encoded(background(*paths), size)


def _step(task: tuple[dict[str, np.ndarray], int]) -> tuple[float, dict[str, np.ndarray]]:
    w, seed = task
    rng, (ids, tags) = np.random.default_rng(seed), _STREAM
    take = rng.integers(0, len(ids) - STEPS, BATCH)[None, :] + np.arange(STEPS)[:, None]
    return gradients(w, ids[take], tags[take], rng)


def train(paths: list[str], seconds: float = 420, size: int = 4_000_000, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """WORKERS processes, each with examples of its own, give the gradients of a step together."""
    rng = np.random.default_rng(7)
    d, h, k = EMBEDDING, HIDDEN, len(TAGS)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"e": rng.standard_normal((VOCABULARY, d)).astype(np.float32) * 0.3, "wo": init(2 * h, k), "bo": np.zeros(k, np.float32), "a": np.zeros((k, k), np.float32), "s": np.zeros(k, np.float32)}
    for x in "fb":
        w |= {f"{x}_wx": init(d, 4 * h), f"{x}_wh": init(h, 4 * h), f"{x}_b": np.zeros(4 * h, np.float32)}
        w[f"{x}_b"][h : 2 * h] = 1
    w = {x: y.astype(np.float32) for x, y in start.items()} if start else w
    m, v = {x: np.zeros_like(y) for x, y in w.items()}, {x: np.zeros_like(y) for x, y in w.items()}
    workers = [ProcessPoolExecutor(1, initializer=_prepare, initargs=(paths, size, (70 if start else 7) + i)) for i in range(WORKERS)]
    for x in [x.submit(len, ()) for x in workers]:
        x.result()
    began, step, shown = time.time(), 0, 0.0
    while (spent := (time.time() - began) / seconds) < 1:
        step += 1
        done = [x.result() for x in [p.submit(_step, (w, step * WORKERS + i)) for i, p in enumerate(workers)]]
        loss = sum(x[0] for x in done) / WORKERS
        g = {q: sum(x[1][q] for x in done) / WORKERS for q in w}
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        rate = (3e-3 if start else 6e-3) * min(1, step / 50) * (0.5 + 0.5 * np.cos(np.pi * spent)) + 1e-5
        for q in w:
            own = g[q] * min(1, 1 / (norm + 1e-9))
            m[q] += 0.1 * (own - m[q])
            v[q] += 0.002 * (own * own - v[q])
            w[q] = w[q] - (rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        if time.time() - began > shown + 30:
            shown = time.time() - began
            print(f"{shown:.0f} s, step {step}, loss {loss:.5f}", flush=True)
    for x in workers:
        x.shutdown(cancel_futures=True)
    return w


if __name__ == "__main__":
    tables = [x for x in sys.argv[2:] if x != "--go-on"]
    start = dict(np.load(WEIGHTS)) if "--go-on" in sys.argv else None
    found = train(tables, float(sys.argv[1]), start=start)
    if start:
        found = {k: (1 - MEAN) * start[k].astype(np.float32) + MEAN * v for k, v in found.items()}
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in found.items()})
    print(WEIGHTS, WEIGHTS.stat().st_size)
