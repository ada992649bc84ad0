"""A held-out test of problem 6: wordings, names, streets and numbers that were written for this file and occur neither in the training
material nor in the test tables. 390 sentences, 60 of them without personal information."""

from collections import Counter

import pytest

from corpusloom.llm import personal

NAMES = """Hannelore Fuchs|Priya Raghunathan|Marguerite Delacroix|Tobias Lindqvist|Siobhan Gallagher|Rajesh Venkataraman|Penelope Ashcroft|Mr. Abernathy|Dr. Eleanor Whitcombe|Nikolai Vasiliev
Beatriz Figueroa|Ms. Okonkwo|Gareth Llewellyn|Prof. Zimmermann|Theodora Papadakis|Aleksander Wisniewski|Harriet B. Pemberton|Mrs. Castellano|Jean-Luc Fontaine|Emeka Adeyemi
Rosalind Chatterjee|Dr. Kaminski|Lorenzo Bianchi|Wilhelmina Vandenberg|Callum Fitzgerald""".replace("\n", "|").split("|")
NAMES_ZH = "王建国 刘晓燕 陈志远 赵雅琴 周文博 吴秀兰 徐海涛 孙丽华 马晓东 朱明哲 林婉清 何俊杰 郭永强 罗诗涵 梁国栋 宋佳怡 郑浩宇 谢丹丹 韩雪梅 唐振华".split()
EMAILS = """hannelore.fuchs@stadtwerke-koeln.de|priya_r@techmail.in|j.fontaine@univ-lyon.fr|support+billing@acme-tools.com|gllewellyn88@cardiff.ac.uk|wang.jianguo@sinodata.com.cn|m-castellano@studioverde.it|theodora@papadakis.gr|TOBIAS.LINDQVIST@KTH.SE
callum at fitzgerald dot ie|eleanor [at] whitcombe [dot] org|b.figueroa@correo.mx|r.chatterjee@kolkata-press.in|emeka (at) adeyemi (dot) ng|press@museumofglass.org""".replace("\n", "|").split("|")
PHONES = """+49 221 4710882|(718) 555-0142|13911286634|+86 138 2291 7745|0161 496 0557|+33 1 47 20 00 14|212-867-5309|010-6552-9988|+44 117 496 0132|+91 98450 12345|650.253.0000|021-54348877|+1 604 555 0199|187-2210-4456|+39 06 6982 4567""".split("|")
STREETS = """27 Kingsley Avenue|14 Thornbury Road|802 Magnolia Street|5 Ferndale Close|1190 Lexington Ave, Apt 6C|Flat 3, 48 Carlton Terrace|63 Wexford Lane|2215 Sycamore Drive|9 Bramble Court|331 Hawthorne Blvd, Madison|77 Pembroke Place|16 Ludlow Street, York|440 Juniper Way|Unit 12, 90 Harbour Street|58 Rosewood Crescent""".split("|")
STREETS_ZH = "南京西路1376号 杭州市文三路478号 朝阳区建国路93号 天河区体育东路116号3栋502室 武汉市珞喻路1037号 成都市春熙路88号 丰台区莲花池东路120号 苏州市观前街25号 厦门市湖滨南路334号2号楼1806室 西安市雁塔路56号".split()
IDENTITIES = """SSN 219-09-9999|social security number 457-55-5462|NI number JG 10 37 59 A|passport no. X12345678|passport L88902137|national ID 440524198001010014|ID card 320311197707079315|310101 19900307 7571|AB 12 34 56 C|078-05-1120""".split("|")
IDENTITIES_ZH = "110105194912310021|440308199901101512|33010419851125473X|510107 19830914 2216".split("|")

CARRIERS = {
    "person_name": (NAMES, ("Yesterday {} forgot the keys in the meeting room.", "The minutes were taken by {}.", "Could you forward this to {} before lunch?", "{} has been promoted to head of sales.", "Reviewed and approved: {}", "Our landlord, {}, raised the rent again.", "I spoke with {} about the leaking roof.", "Dear {}, we received your application.", "The violin belongs to {}.", "Sincerely, {}")),
    "person_zh": (NAMES_ZH, ("昨天{}没有来上班。", "请{}同志到前台领取快递。", "会议由{}主持。", "主治医师：{}", "我在车站遇见了{}。", "经办人：{}，日期另行通知。", "感谢{}老师的耐心指导。")),
    "email": (EMAILS, ("Send the invoice to {} by Friday.", "My new address is {}, please update it.", "Reply-To: {}", "For refunds write to {}.", "报名请发送简历至{}。", "有问题可以联系{}。", "the account {} was locked")),
    "phone": (PHONES, ("You can reach the plumber on {}.", "Emergency contact: {}", "Dial {} and ask for reception.", "My mobile is {}, call any time.", "预约请打{}。", "维修师傅的电话是{}，记得提前联系。", "Missed call from {} at noon.")),
    "street_address": (STREETS, ("The wedding takes place at {}.", "Please ship the lamp to {}.", "He grew up at {}, near the bakery.", "Our new studio: {}", "The fire started at {} around midnight.", "Meet the agent outside {}.")),
    "address_zh": (STREETS_ZH, ("快递请送到{}。", "新店开在{}，欢迎光临。", "她的老家在{}。", "发票抬头和地址：{}", "集合地点为{}门口。")),
    "identity_number": (IDENTITIES, ("The applicant gave {} as proof.", "Copy of {} attached.", "We could not verify {} in the register.", "Please keep {} confidential.")),
    "identity_zh": (IDENTITIES_ZH, ("身份证号码为{}，请核实。", "投保人证件号：{}", "他的身份证是{}。")),
}
KIND = {"person_zh": "person_name", "address_zh": "street_address", "identity_zh": "identity_number"}
SENTENCES = {"person_name": 60, "person_zh": 50, "email": 55, "phone": 55, "street_address": 40, "address_zh": 30, "identity_number": 28, "identity_zh": 12}

NOTHING = """The cache holds 4503599627370496 entries.|Order 88120934 left the warehouse at dawn.|The Hubble Telescope orbits the Earth every 95 minutes.|Version 14.2.7 fixes the memory leak.|We painted the kitchen in Arctic Blue.|Baker Street is crowded in summer.
Ticket 20391847 was merged into ticket 20391846.|The Fourier Transform turns time into frequency.|Invoice total: 1,204,553.20|She ran 42.195 kilometres in the rain.|The decorator @lru_cache speeds it up.|Install numpy==2.1.3 before running.|The Pacific Ocean is deeper than expected.|Checksum 9f86d081884c7d65 differs.|Chapter 12 begins on page 311.
Flight BA2490 was delayed by 35 minutes.|The train to the coast leaves at 10:42.|Use port 8080 or 8443.|IP 192.168.10.254 is unreachable.|On 2021-03-14 the clocks changed.|The Great Barrier Reef needs protection.|Model XR-7720 is out of stock.|The ImageNet Benchmark was extended twice.|Turn left on Elm Road and walk on.|There are 12 roads and 4 bridges in the valley.
The loss fell from 3.214 to 2.907.|Room 404 is on the fourth floor.|Monday and Tuesday are holidays.|The index grew to 1872634 rows.|ISBN 978-3-16-148410-0 is a sample.|Latitude 48.8566 and longitude 2.3522.|The Random Forest outperforms the baseline.|Batch 77120 failed twice in a row.|Press Ctrl-C to stop the server.|An apple a day keeps the doctor away.
订单编号202405170093已经发货。|第三章介绍了损失函数。|这款手机售价4999元。|会议室在五楼东侧。|该算法的复杂度是线性的。|上海的夏天非常潮湿。|模型参数量达到70亿。|请在10分钟内完成测试。|这条路正在施工。|数据集共有123456条样本。
文件大小为2048千字节。|版本3.8.1修复了崩溃问题。|人民广场附近有三家书店。|李子和桃子都成熟了。|高铁时速可达350公里。|张贴通知之前请先审核。|快递单号SF1029384756尚未更新。|周末我们去爬山。|江河湖海都需要保护。|白天气温回升到25度。
The museum opens at nine.|Nothing was found in the archive.|Please water the plants twice a week.|Two thirds of the sample were discarded.|温度传感器每5秒上报一次。""".replace("\n", "|").split("|")


def sentences():
    for kind, n in SENTENCES.items():
        items, carriers = CARRIERS[kind]
        for k in range(n):
            yield carriers[(k + k // len(carriers)) % len(carriers)].format(items[k % len(items)]), KIND.get(kind, kind)
    for x in NOTHING:
        yield x, None


@pytest.fixture(scope="module")
def counts():
    every = list(sentences())
    found = personal.find_spans(personal.load(personal.WEIGHTS.read_bytes()), [x for x, _ in every])
    out = Counter()
    for (text, kind), own in zip(every, found, strict=True):
        got = {k for _, _, k in own}
        out["sentences"] += 1
        out[kind, "true"] += 1
        out[kind, "hit"] += kind in got
        for k in got - {kind}:
            out[k, "wrong"] += 1
    return out


def test_size(counts):
    assert counts["sentences"] >= 390 and len({x for x, _ in sentences()}) >= 330


@pytest.mark.parametrize("kind", personal.TYPES)
def test_recall_and_precision(counts, kind):
    hit, true, wrong = counts[kind, "hit"], counts[kind, "true"], counts[kind, "wrong"]
    print(f"{kind}: {hit} of {true}, {wrong} wrong")
    assert hit / true >= 0.9 and hit / max(1, hit + wrong) >= 0.9
