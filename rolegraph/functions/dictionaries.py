"""Phrase dictionaries: the defaults of every operator's `phrases` parameter.

A dictionary is a mapping from a phrase to its value; for_spark() makes the small table that operators join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def pairs(text: str) -> dict[str, str]:
    return dict((k.strip(), v.strip()) for k, v in (line.split(" = ") for line in text.strip().splitlines()))


def for_spark(spark: SparkSession, phrases: Mapping[str, str], key=None) -> DataFrame:
    """phrase, value; bounded by the size of the mapping."""
    return spark.createDataFrame([((key or str)(p), v) for p, v in phrases.items()], "phrase string, value string")


# Titles, skills, fields, levels, languages, certificates, places, industries, headings, signals.
TITLES = pairs("""
yazılım geliştirme uzmanı = software developer
yazılım geliştirici = software developer
software developer = software developer
yazılım mühendisi = software engineer
software engineer = software engineer
bilgisayar mühendisi = computer engineer
computer engineer = computer engineer
backend developer = backend developer
backend geliştirici = backend developer
kaynak mühendisi = welding engineer
welding engineer = welding engineer
planlama mühendisi = planning engineer
planning engineer = planning engineer
üretim mühendisi = production engineer
production engineer = production engineer
kalite mühendisi = quality engineer
quality engineer = quality engineer
bakım mühendisi = maintenance engineer
maintenance engineer = maintenance engineer
""")
TITLE_VARIANTS = pairs("""
software developer = yazılım geliştirici|yazılım geliştirme uzmanı
software engineer = yazılım mühendisi
computer engineer = bilgisayar mühendisi
backend developer = backend geliştirici
welding engineer = kaynak mühendisi
planning engineer = planlama mühendisi
production engineer = üretim mühendisi
quality engineer = kalite mühendisi
maintenance engineer = bakım mühendisi
""")
#: value: normalized name, category
SKILLS = pairs("""
python = python|programming_language
c# = c#|programming_language
java = java|programming_language
javascript = javascript|programming_language
typescript = typescript|programming_language
sql = sql|database
sql server = sql server|database
postgresql = postgresql|database
mysql = mysql|database
oracle = oracle|database
rest api = rest api|framework
graphql = graphql|framework
dotnet = dotnet|framework
asp.net = asp.net|framework
asp.net core = asp.net core|framework
react = react|framework
angular = angular|framework
vue = vue|framework
fastapi = fastapi|framework
django = django|framework
flask = flask|framework
git = git|devops
docker = docker|devops
kubernetes = kubernetes|devops
linux = linux|devops
azure = azure|cloud
aws = aws|cloud
power bi = power bi|data
excel = excel|office
power automate = power automate|office
sharepoint = sharepoint|office
jde = jde|erp
jd edwards = jd edwards|erp
erp = erp|erp
mrp = mrp|erp
autocad = autocad|engineering
solidworks = solidworks|engineering
catia = catia|engineering
sap = sap|erp
primavera p6 = primavera p6|project_management
ms project = ms project|project_management
iso 9001 = iso 9001|quality
iso 3834 = iso 3834|quality
asme = asme|engineering
aws d1.1 = aws d1.1|engineering
welding = welding|manufacturing
welded manufacturing = welded manufacturing|manufacturing
ndt = ndt|quality
quality control = quality control|quality
production planning = production planning|manufacturing
maintenance = maintenance|manufacturing
cnc = cnc|manufacturing
plc = plc|manufacturing
lean manufacturing = lean manufacturing|manufacturing
six sigma = six sigma|quality
5s = 5s|quality
fmea = fmea|quality
ppap = ppap|quality
apqp = apqp|quality
kaizen = kaizen|quality
ms sql = sql server|database
microsoft sql server = sql server|database
sqlserver = sql server|database
restful api = rest api|framework
rest apis = rest api|framework
.net = dotnet|framework
.net core = dotnet|framework
js = javascript|programming_language
ts = typescript|programming_language
powerbi = power bi|data
ms excel = excel|office
kaynaklı imalat = welded manufacturing|manufacturing
üretim planlama = production planning|manufacturing
kalite kontrol = quality control|quality
bakım = maintenance|manufacturing
""")
EDUCATION_FIELDS = pairs("""
bilgisayar mühendisliği = computer engineering
computer engineering = computer engineering
yazılım mühendisliği = software engineering
software engineering = software engineering
elektrik-elektronik mühendisliği = electrical and electronics engineering
electrical and electronics engineering = electrical and electronics engineering
elektronik mühendisliği = electronics engineering
electronics engineering = electronics engineering
makine mühendisliği = mechanical engineering
mechanical engineering = mechanical engineering
endüstri mühendisliği = industrial engineering
industrial engineering = industrial engineering
metalurji ve malzeme mühendisliği = metallurgical and materials engineering
metallurgical and materials engineering = metallurgical and materials engineering
malzeme mühendisliği = materials engineering
materials engineering = materials engineering
mekatronik mühendisliği = mechatronics engineering
mechatronics engineering = mechatronics engineering
kimya mühendisliği = chemical engineering
chemical engineering = chemical engineering
inşaat mühendisliği = civil engineering
civil engineering = civil engineering
işletme = business administration
business administration = business administration
iktisat = economics
economics = economics
istatistik = statistics
statistics = statistics
""")
EDUCATION_LEVELS = pairs("""
lise = high_school
high school = high_school
ön lisans = associate
önlisans = associate
associate degree = associate
lisans = bachelor
bachelor's degree = bachelor
bachelors degree = bachelor
yüksek lisans = master
master's degree = master
masters degree = master
doktora = doctorate
phd = doctorate
doctorate = doctorate
""")
LANGUAGES = pairs("""
türkçe = turkish
turkish = turkish
ingilizce = english
english = english
almanca = german
german = german
fransızca = french
french = french
ispanyolca = spanish
spanish = spanish
arapça = arabic
arabic = arabic
rusça = russian
russian = russian
italyanca = italian
italian = italian
çince = chinese
chinese = chinese
japonca = japanese
japanese = japanese
""")
PROFICIENCIES = pairs("""
başlangıç = beginner
beginner = beginner
temel = elementary
elementary = elementary
orta = intermediate
intermediate = intermediate
upper-intermediate = upper_intermediate
iyi derecede = good
iyi = good
good = good
çok iyi = advanced
ileri seviye = advanced
ileri = advanced
advanced = advanced
akıcı = fluent
fluent = fluent
ana dil = native
native = native
""")
CERTIFICATIONS = pairs("""
iso 9001 = iso 9001
iso9001 = iso 9001
iso 14001 = iso 14001
iso14001 = iso 14001
iso 45001 = iso 45001
iso45001 = iso 45001
iso 3834 = iso 3834
iso3834 = iso 3834
aws d1.1 = aws d1.1
asme section ix = asme section ix
pmp certificate = pmp
pmp = pmp
prince2 = prince2
six sigma green belt = six sigma green belt
six sigma black belt = six sigma black belt
iwe = iwe
iwt = iwt
cswip = cswip
ndt level ii = ndt level 2
ndt level 2 = ndt level 2
cwi = cwi
scrum master = scrum master
aws certified solutions architect = aws certified solutions architect
azure certification = azure certification
azure certifications = azure certification
aws certification = aws certification
aws certifications = aws certification
""")
LOCATIONS = pairs("""
bursa = city:bursa
gemlik = city:gemlik
kocaeli = city:kocaeli
istanbul = city:istanbul
ankara = city:ankara
izmir = city:izmir
türkiye = country:turkey
turkey = country:turkey
remote = work_mode:remote
uzaktan = work_mode:remote
hybrid = work_mode:hybrid
hibrit = work_mode:hybrid
on-site = work_mode:on_site
onsite = work_mode:on_site
ofiste = work_mode:on_site
""")
INDUSTRIES = pairs("""
software = software
yazılım = software
information technology = information technology
bilgi teknolojileri = information technology
manufacturing = manufacturing
üretim = manufacturing
heavy industry = heavy industry
ağır sanayi = heavy industry
steel = steel
çelik = steel
piping = piping
borulama = piping
welding = welding
kaynak = welding
energy = energy
enerji = energy
oil and gas = oil and gas
petrol ve gaz = oil and gas
lng = lng
mining = mining
madencilik = mining
automotive = automotive
otomotiv = automotive
construction = construction
inşaat = construction
engineering = engineering
mühendislik = engineering
quality = quality
kalite = quality
maintenance = maintenance
bakım = maintenance
production = production
""")
HEADINGS = pairs("""
aranan nitelikler = required
genel nitelikler = optional
iş tanımı = optional
görev ve sorumluluklar = optional
tercihen = preferred
zorunlu = required
gereklilikler = required
yetkinlikler = optional
eğitim = optional
deneyim = optional
yabancı dil = optional
sertifikalar = optional
lokasyon = optional
qualifications = optional
requirements = required
job description = optional
responsibilities = optional
preferred qualifications = preferred
must have = required
nice to have = preferred
education = optional
experience = optional
languages = optional
certifications = optional
location = optional
""")
SIGNALS = pairs("""
zorunlu = required
şart = required
gerekmektedir = required
sahip olmak = required
en az = required
mutlaka = required
aranmaktadır = required
beklenmektedir = required
required = required
must = required
mandatory = required
minimum = required
shall = required
need to = required
expected to = required
tercihen = preferred
tercih sebebidir = preferred
avantajdır = preferred
artı olacaktır = preferred
olması tercih edilir = preferred
preferred = preferred
nice to have = preferred
plus = preferred
advantage = preferred
desirable = preferred
opsiyonel = optional
optional = optional
bonus = optional
""")
#: English titles, then Turkish ones.
QUERY_TITLES = pairs("""
software developer = Software Developer|Software Engineer|Backend Developer;Yazılım Geliştirici|Yazılım Mühendisi
software engineer = Software Engineer|Software Developer|Backend Developer;Yazılım Mühendisi|Yazılım Geliştirici
computer engineer = Computer Engineer|Computer Engineering;Bilgisayar Mühendisi|Bilgisayar Mühendisliği
welding engineer = Welding Engineer|Welding Specialist;Kaynak Mühendisi|Kaynak Uzmanı
planning engineer = Planning Engineer|Project Planning Engineer|Production Planning Engineer;Planlama Mühendisi|Üretim Planlama Mühendisi
production engineer = Production Engineer|Manufacturing Engineer;Üretim Mühendisi|İmalat Mühendisi
quality engineer = Quality Engineer|Quality Control Engineer;Kalite Mühendisi|Kalite Kontrol Mühendisi
maintenance engineer = Maintenance Engineer;Bakım Mühendisi
mechanical engineer = Mechanical Engineer;Makine Mühendisi
industrial engineer = Industrial Engineer;Endüstri Mühendisi
metallurgical engineer = Metallurgical Engineer|Materials Engineer|Metallurgical and Materials Engineer;Metalurji Mühendisi|Malzeme Mühendisi|Metalurji ve Malzeme Mühendisi
""")
GENERIC_SKILLS = "office communication teamwork engineering software computer quality production".split()
LOCATION_NAMES = pairs("""
türkiye = Turkey
turkey = Turkey
istanbul = Istanbul
i̇stanbul = Istanbul
izmir = Izmir
i̇zmir = Izmir
bursa = Bursa
gemlik = Gemlik
kocaeli = Kocaeli
ankara = Ankara
remote = Remote
uzaktan = Uzaktan
hybrid = Hybrid
hibrit = Hibrit
""")
CITIES = pairs("""
bursa = Bursa
istanbul = Istanbul
i̇stanbul = Istanbul
kocaeli = Kocaeli
gemlik = Gemlik
""")
COUNTRIES = pairs("""
turkey = Turkey
türkiye = Turkey
turkiye = Turkey
""")
SNIPPET_PLACES = ["Bursa", "Istanbul", "İstanbul", "Kocaeli", "Ankara", "Izmir", "İzmir", "Gemlik"]
PLACEHOLDER_NAMES = ["linkedin", "profile", "user", "member", "linkedin member", "test", "unknown", "n/a"]
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content trk trackingid ref refid sessionid lipi midtoken".split()
SEARCH_ENGINES = ["google.com", "www.google.com", "bing.com", "www.bing.com", "yahoo.com"]
BLOCKED_PATHS = ["/company/", "/jobs/", "/school/", "/search/", "/feed/"]
PRESENT_WORDS = ["present", "current", "günümüz", "halen", "devam ediyor"]
MONTHS = pairs("""
jan = 1
january = 1
oca = 1
ocak = 1
feb = 2
february = 2
şub = 2
şubat = 2
mar = 3
march = 3
mart = 3
apr = 4
april = 4
nis = 4
nisan = 4
may = 5
mayıs = 5
jun = 6
june = 6
haz = 6
haziran = 6
jul = 7
july = 7
tem = 7
temmuz = 7
aug = 8
august = 8
ağu = 8
ağustos = 8
sep = 9
september = 9
eyl = 9
eylül = 9
oct = 10
october = 10
eki = 10
ekim = 10
nov = 11
november = 11
kas = 11
kasım = 11
dec = 12
december = 12
ara = 12
aralık = 12
""")
SENSITIVE_KEYS = "authorization cookie email password phone session session_token".split()
QUALITY_WEIGHTS = {"full_name": 15, "normalized_profile_url": 15, "headline": 10, "location": 10, "current_title": 10, "current_company": 10, "about": 5, "discovery_snippet": 5, "experience": 10, "education": 5, "skills": 5}
SOURCE_CAPS = {"profile_skill": 1.0, "experience_text": 0.8, "about_text": 0.7, "inferred": 0.5, "manual": 1.0}
MATCH_WEIGHTS = {"title": 15, "skill": 30, "experience": 15, "industry": 10, "education": 10, "location": 10, "language": 5, "certification": 5}
