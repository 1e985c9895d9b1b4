"""Every constant of the search semantics, in one place."""

STOP_WORDS = frozenset(
    """a about am an and any are as at be been being but by for from he her hers him his i in is it its just me mine more most my
    nor not of on only or our ours she so some that the their theirs them these they this those to too us very was we were
    with yet you your yours""".split()
)
STOP_WORDS_SHORT = frozenset("a an and are as at be by for from has he in is it its of on that the to was were will with".split())
DICTIONARY_STOP_WORDS = frozenset("all and are but can day for had her not one our the was you".split())
VIEW_STOP_WORDS = DICTIONARY_STOP_WORDS | frozenset("boy did get has him his how its man may men new now old put say see she too two use who".split())

BM25_K1, BM25_B = 1.2, 0.75
BLEND_DB, BLEND_BM25 = 0.3, 0.7
FIELD_WEIGHTS = {"name": 3.0, "title": 3.0, "description": 1.5, "tags": 1.0, "content": 1.0}
PATTERN_WEIGHTS = [(10.0, "name title"), (2.0, "category category_name subcategory sub_category_name"), (1.5, "overview summary description"), (1.0, "text content tags")]
#: Labels of the fields of a weighted vector, and what an occurrence under a label weighs.
VECTOR_LABELS = {"name": "A", "title": "A", "category_name": "B", "sub_category_name": "B", "description": "C", "profile": "C"}
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LABELS = [(10.0, "A"), (5.0, "B"), (2.0, "C")]
LIKE_FIELDS = frozenset("category_name description location_text name profile sub_category_name tags title".split())
FLAGS = ("is_active", "is_blocked", "is_verified")

TIER_EXACT, TIER_CLOSE, TIER_OTHER = 10_000, 5_000, 1_000
CONFIRMED_BOOST, FEATURED_BOOST = 2_000, 500
RRF_K = 60
TRIGRAM_THRESHOLD, CLASSIFIER_SIMILARITY, SEMANTIC_THRESHOLD, FALLBACK_SIMILARITY, DIRECT_SIMILARITY = 0.3, 0.6, 0.7, 0.4, 0.2
EARTH_RADIUS_M, MILE_M = 6_371_000.0, 1609.34
DEFAULT_RADIUS_M, CITY_RADIUS_M, AREA_RADIUS_M = 5_000.0, 10_000.0, 5_000.0
PAGE_SIZE, MOST_PAGE_SIZE = 10, 100

TRANSACTIONAL = ("appointment", "book", "buy", "delivery", "order", "reserve")
NAVIGATIONAL = ("address", "close to", "directions", "location", "near", "where")

_AREAS = """agege 6.6167 3.3333|ajah 6.4654 3.5658|alimosho 6.6 3.25|amowo-odofin 6.55 3.3|apapa 6.45 3.3667|badagry 6.4167 2.8833|epe 6.5833 3.9833
|ibeju-lekki 6.4654 3.5658|ifako-ijaiye 6.65 3.3|ikeja 6.6018 3.3515|ikorodu 6.6167 3.5167|ikoyi 6.4528 3.4333|island 6.45 3.4|kosofe 6.55 3.4
|lagos island 6.45 3.4|lagos mainland 6.5 3.4|lekki 6.4654 3.5658|mainland 6.5 3.4|mushin 6.5333 3.35|oshodi 6.55 3.3333|oshodi-isolo 6.55 3.3333
|shomolu 6.5333 3.3667|somolu 6.5333 3.3667|surulere 6.5 3.35|victoria island 6.4281 3.4219|yaba 6.5083 3.3833"""
_CITIES = """abuja 9.082 7.3986|akure 7.25 5.2|bauchi 10.3158 9.8442|benin city 6.3176 5.6145|birnin kebbi 12.4539 4.1975|calabar 4.9757 8.3417|damaturu 11.7489 11.9661
|dutse 11.8283 9.315|enugu 6.4584 7.5464|gombe 10.2897 11.1673|gusau 12.17 6.6644|ibadan 7.3961 3.8969|ilorin 8.5 4.55|jalingo 8.9 11.3667|jos 9.8965 8.8583
|kaduna 10.5222 7.4384|kano 11.9914 8.5317|katsina 12.9908 7.6018|lafia 8.5 8.5167|lagos 6.5244 3.3792|maiduguri 11.8333 13.15|markurdi 7.7333 8.5333|minna 9.6139 6.5569
|oyo 7.85 3.9333|port harcourt 4.8156 7.0498|sokoto 13.0627 5.2433|yola 9.2035 12.4954|zaria 11.1111 7.7222"""


def _places(s: str, kind: str) -> dict[str, tuple[float, float, str]]:
    out = {}
    for row in s.replace("\n", "").split("|"):
        name, lat, lng = row.rsplit(" ", 2)
        out[name] = (float(lat), float(lng), kind)
    return out


#: name: (latitude, longitude, kind); an area hides a city of the same name.
GAZETTEER = _places(_CITIES, "city") | _places(_AREAS, "area")

#: business type: words that stand for it.
BUSINESS_TYPES = {
    k: v.split(",")
    for k, v in (
        row.strip().split("=")
        for row in """accountant=accountant,accounting,financial advisor,tax; agent=agent,broker,property,real estate; airport=air travel,airport,aviation,flight
; atm=atm,bank machine,cash machine,money machine; bank=atm,banking,credit union,finance,financial,money; barber=barber,grooming,haircut,men's hair
; bus=bus,public transport,transit,transport; cafe=beverage,breakfast,cafe,coffee,coffee shop,tea; car=auto,automotive,car,motor,vehicle
; church=church,faith,religious,worship; cinema=cinema,entertainment,film,movie,theater; cleaner=cleaner,cleaning,housekeeping,janitorial
; clinic=clinic,dental,doctor,healthcare,hospital,medical,pharmacy; club=club,entertainment,nightclub,party; conference=business,conference,event,meeting
; consultant=advisor,consultant,consulting,expert; dental=dental,dentist,oral health,teeth; electrician=electrical,electrician,power,wiring
; electronics=computer,electronics,gadget,phone,tech; fashion=apparel,clothing,fashion,style,wear; fast food=fast,fast food,quick food,takeaway,takeout
; fitness=exercise,fitness,gym,training,workout; gaming=arcade,entertainment,game,gaming; gas station=filling station,fuel,gas,gas station,petrol
; government=administration,government,official,public; guesthouse=bed and breakfast,bnb,guesthouse,inn; gym=exercise,fitness,gym,sports,training,workout
; hospital=emergency,healthcare,hospital,medical center; hotel=accommodation,guesthouse,hostel,inn,lodging,motel,resort; insurance=coverage,insurance,policy,protection
; it=computer,information technology,it,tech,technology; laboratory=diagnostic,lab,laboratory,testing; lawyer=advocate,attorney,law,lawyer,legal
; mall=mall,plaza,shopping center,shopping mall; mechanic=auto repair,automotive,car service,mechanic; mosque=islamic,mosque,prayer,religious
; nail=manicure,nail,nail art,pedicure; pharmacy=chemist,drugstore,medical store,pharmacy; pizza=delivery,italian,pizza,takeout; plumber=pipe,plumber,plumbing,water
; police=authority,law enforcement,police,security; post office=mail,post office,postal,shipping; real estate=housing,property,real estate,realty
; resort=beach resort,holiday,mountain resort,resort,vacation; restaurant=bar,bistro,cafe,dining,eatery,food,grill,kitchen,pub; salon=beauty,cosmetics,hair,salon,spa,styling
; school=academy,college,education,institute,school,university; security=guard,protection,safety,security; shop=grocery,mall,market,retail,shop,store,supermarket
; software=app,digital,software,tech,technology; spa=beauty,massage,relaxation,spa,wellness; sports=athletic,fitness,sports,training
; supermarket=food store,grocery,market,supermarket; swimming=aquatic,pool,swimming,water sports; taxi=cab,car service,ride,taxi,transport
; temple=faith,religious,temple,worship; training=course,education,learning,training,workshop; university=campus,college,higher education,university
; venue=event,facility,hall,space,venue; web design=digital,online,web design,website; wedding=ceremony,marriage,reception,wedding""".split(";")
    )
}
SERVICES = "24/7,appointment,booking,curbside,delivery,drive-thru,emergency,home service,mobile,online,pickup,reservation,takeout,urgent,walk-in".split(",")
MODIFIERS = "affordable best budget busy cheap crowded expensive famous fast luxury new old popular quick quiet rated recommended slow top".split()
SYNONYMS = {k: BUSINESS_TYPES[k] for k in ("bank", "clinic", "gym", "hotel", "restaurant", "salon", "school", "shop")} | {
    "24/7": ["24 hours", "24/7", "all day", "all night", "always open"], "appointment": ["appointment", "booking", "reservation", "schedule"],
    "delivery": ["deliver", "delivery", "door delivery", "home delivery"], "emergency": ["asap", "emergency", "immediate", "urgent"], "takeout": ["pickup", "take away", "take-away", "takeout", "to go"],
}
COMMON_TYPOS = {"resturant": "restaurant", "restarant": "restaurant", "hotl": "hotel", "pharmcy": "pharmacy", "hospitel": "hospital", "bannk": "bank", "univeristy": "university", "colege": "college"}
#: Words of names so common that they count as frequent without being counted.
BUSINESS_WORDS = frozenset(
    """bank beauty business center clinic company complex consulting drink education finance food health hospital hotel mall manufacturing
    market office plaza restaurant retail salon school service shop store technology university wholesale""".split()
)
