"""Names, scales and patterns that results must agree with."""

from __future__ import annotations

# --- fixed values: cities ------------------------------------------------------------
CITY = {
    "medellin": "Medellín", "medellin antioquia": "Medellín", "belen": "Medellín", "bogota": "Bogotá", "bogota dc": "Bogotá",
    "cucuta": "Cúcuta", "barranquilla": "Barranquilla", "santa marta": "Santa Marta", "cali": "Cali", "cartagena": "Cartagena",
    "bucaramanga": "Bucaramanga", "ipiales": "Ipiales", "pasto": "Pasto", "riohacha": "Riohacha", "maicao": "Maicao",
    "soacha": "Soacha", "soacha cundinamarca": "Soacha", "necocli": "Necoclí",
}
NOT_A_CITY = ["colombia", "cundinamarca", "antioquia", "otra", "nan", ""]
CITY_WHOLE_ONLY = ["belen", "cali"]
OTHER_CITY = "Otra"
DEPARTMENT = {
    "Medellín": "Antioquia", "Bogotá": "Bogotá", "Cúcuta": "Norte de Santander", "Barranquilla": "Atlántico", "Santa Marta": "Magdalena",
    "Cali": "Valle del Cauca", "Cartagena": "Bolívar", "Bucaramanga": "Santander", "Ipiales": "Nariño", "Pasto": "Nariño",
    "Riohacha": "La Guajira", "Maicao": "La Guajira", "Soacha": "Cundinamarca", "Necoclí": "Antioquia",
}
# --- fixed values: nationality -------------------------------------------------------
NATIONALITY = {
    "venezuela": "Venezuela", "venezolana": "Venezuela", "venezolano": "Venezuela", "ecuador": "Ecuador", "ecuatoriana": "Ecuador",
    "ecuatoriano": "Ecuador", "peru": "Peru", "peruana": "Peru", "peruano": "Peru", "colombia": "Colombia", "colombiana": "Colombia",
    "colombiano": "Colombia", "united states": "United States", "estados unidos": "United States", "cuba": "Cuba", "cubana": "Cuba",
    "cubano": "Cuba", "panama": "Panama", "panamena": "Panama", "panameno": "Panama", "chile": "Chile", "chilena": "Chile",
    "chileno": "Chile", "argentina": "Argentina", "brasil": "Brazil", "brazil": "Brazil", "brasilena": "Brazil", "brasileno": "Brazil",
    "haiti": "Haiti", "haitiana": "Haiti", "haitiano": "Haiti", "mexico": "Mexico", "mexicana": "Mexico", "mexicano": "Mexico",
    "nicaragua": "Nicaragua", "costa rica": "Costa Rica", "el salvador": "El Salvador", "republica dominicana": "Dominican Republic",
    "noruega": "Norway", "norway": "Norway", "bulgaria": "Bulgaria", "india": "India", "mexico mexicana": "Mexico",
    "otro": "Desconocida", "otra": "Desconocida",
}
UNKNOWN_NATIONALITY = "Desconocida"
# --- fixed values: ordered scales, least first ---------------------------------------
AWAY = {"Menos de 1 mes": "< 1 month", "Entre 1 a 3 meses": "1–3 months", "Entre 3 meses y 1 año": "3–12 months", "Entre 1 a 5 años": "1–5 years", "Hace más de 5 años": "5+ years"}
IN_CITY = {"Menos de 1 mes": "< 1 month", "Entre 1 y 3 meses": "1–3 months", "Entre 4 y 6 meses": "4–6 months", "Entre 7 meses y 1 año": "7–12 months", "Más de 1 año": "1+ year"}
RATING = {"Muy útil": 5, "Útil": 4, "Medianamente útil": 3, "Poco útil": 2, "Nada útil": 1}
AGE_EDGES, AGE_BANDS, AGE_UNKNOWN = [0, 18, 25, 35, 45, 55, 150], ["0-17", "18-24", "25-34", "35-44", "45-54", "55+"], "Not specified"
# --- fixed values: displays ----------------------------------------------------------
GENDER_REST = "Other or prefer not to say"
GENDER = {
    "mujer": "Woman", "femenino": "Woman", "f": "Woman", "hombre": "Man", "masculino": "Man", "m": "Man", "transgenero": "LGBTQ+",
    "trans": "LGBTQ+", "mujer trans": "LGBTQ+", "soy una mujer trans": "LGBTQ+", "hombre trans": "LGBTQ+", "no binario": "LGBTQ+",
    "lgtbq+": "LGBTQ+", "lgbtq+": "LGBTQ+", "lgtbiq+": "LGBTQ+", "lgbtiq+": "LGBTQ+", "gay": "LGBTQ+", "lesbiana": "LGBTQ+", "bisexual": "LGBTQ+",
}
DISCOVERY = {
    "Recomendación de otro migrante": "Another migrant", "Recomendación de una ONG": "An NGO", "Cartelera en un punto de atención": "Service point poster",
    "Redes sociales": "Social media", "Otro": "Other", "Otro migrante": "Another migrant", "Recomendación de ONG": "An NGO", "Punto de atención": "Service point poster",
}
LANGUAGE, LANGUAGE_UNKNOWN = {"es": "Spanish", "en": "English", "fr": "French"}, "Not specified"
YES_NO = {"si": "Yes", "s": "Yes", "no": "No", "prefiero no responder": "Prefer not to say"}
NO_ANSWER, NO_ANSWER_ORDER = "Did not respond", -1
NO_CLUSTER, NO_CLUSTER_NAME, NO_SUBCLUSTER = -1, "No conversation text", -10
# --- fixed values: words of messages -------------------------------------------------
GREETINGS = ["hola", "hi", "hey", "hello", "buenas", "buenos", "buen", "dia", "dias", "día", "días", "tarde", "tardes", "noche", "noches", "saludos", "saludo", "que", "qué", "tal", "cordial", "cordiales", "cordialmente", "gracias"]
GREETING_FILL = ["muchas", "mucho", "muy", "bueno", "buena", "buenisimo", "excelente", "ok", "okay", "vale", "amable", "no", "si", "sí"]
NOISE = ["undefined", "?", ""]
COURTESY = "hola buenas buenos dias tardes noches gracias muchas mil bendiga bendiciones amen dios saludos hi hello ok okay bien vale adios chao hasta luego favor porfavor porfa disculpa disculpe perdon le".split()
STOP = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde dos el ella ellas ellos en entre era es esa ese eso esta este "
    "esto ha hasta hay la las le les lo los mas me mi mis mucho muy nada ni no nos o os para pero poco por porque que quien se sin sobre soy su sus te "
    "tener tengo ti tu tus un una uno unos y ya yo"
).split()
# --- fixed values: phrases before a name, and words after them that are none ----------
NOT_NAMES = (
    "venezolana venezolano colombiana colombiano ecuatoriana ecuatoriano madre padre mama papa migrante refugiada refugiado beneficiaria beneficiario "
    "estudiante menor de del la el las los un una mi muy mayor nueva nuevo soltera soltero casada casado embarazada discapacitada discapacitado desplazada "
    "desplazado victima adulta adulto joven persona mujer hombre tiene esta está necesita es no se ya todavia todavía tambien también nacio nació cumple va "
    "fue quiere sufre padece"
).split()
NAME = r"([A-Za-zÁÉÍÓÚÑáéíóúñ]+)"
NAMING = [r"\bme\s+llamo\b", r"\bmi\s+nombre\s+es\b", r"\bse(?:ñ|n)or(?:a)?\s+[A-Za-zÁÉÍÓÚÑáéíóúñ]+"]
NAMING_SELF = r"\b(?i:soy)\s+"
NAMING_OTHERS = [
    r"\bhabl[eé]\s+con\s+", r"\bme\s+atendi[oó]\s+", r"\bpregunt[eé]\s+por\s+", r"\bme\s+dijo\s+", r"\b(?:el|la)\s+doctor(?:a)?\s+",
    r"\b(?:el|la)\s+abogad[oa]\s+", r"\b(?:el|la)\s+trabajador(?:a)?\s+social\s+",
    r"\bmi\s+(?:hija|hijo|esposa|esposo|mam[aá]|pap[aá]|madre|padre|hermana|hermano|abuela|abuelo|nieta|nieto|sobrina|sobrino|prima|primo|t[ií]a|t[ií]o|cuñada|cuñado|pareja|novia|novio|vecina|vecino)\s+",
]
NAME_PLACE = "[nombre]"
# --- fixed values: places and quadrants on the map ------------------------------------
CITY_PLACE = {
    "Bogotá": (4.7110, -74.0721), "Medellín": (6.2442, -75.5812), "Cali": (3.4516, -76.5320), "Barranquilla": (10.9685, -74.7813), "Cúcuta": (7.8939, -72.5078),
    "Cartagena": (10.3910, -75.4794), "Bucaramanga": (7.1193, -73.1227), "Santa Marta": (11.2408, -74.1990), "Ipiales": (0.8303, -77.6450), "Pasto": (1.2136, -77.2811),
    "Riohacha": (11.5444, -72.9072), "Maicao": (11.3776, -72.2389), "Soacha": (4.5794, -74.2140), "Necoclí": (8.4256, -76.7789),
}
COVERAGE_FLOOR, ENTITY_FLOOR, ENTITY_WARN = 0.80, 0.20, 0.35
# --- fixed values: emotions ----------------------------------------------------------
EMOTIONS = ["others", "joy", "sadness", "anger", "surprise", "disgust", "fear"]
EMOTIONS_DROPPED, EMOTIONS_TRUSTED, EMOTION_MARGIN = ["surprise", "disgust"], ["sadness", "fear", "anger"], 0.15
EMOTION_MARKERS = [
    ("estafa", "fear"), ("temo", "fear"), ("nervios", "fear"), ("corre peligro", "fear"), ("corre en peligro", "fear"), ("maltrata", "anger"),
    ("maltrato", "anger"), ("chantaje", "anger"), ("no me han ayudado", "anger"), ("no me ayudan", "anger"), ("no me atienden", "anger"),
    ("deprimid", "sadness"), ("muy dificil", "sadness"), ("muy difícil", "sadness"), ("cáncer", "sadness"), ("cancer", "sadness"),
    ("fallecid", "sadness"), ("desplazad", "sadness"), ("apoyo psicosocial", "sadness"), ("atención psicosocial", "sadness"),
    ("dialisis", "sadness"), ("diálisis", "sadness"),
]
# --- fixed values: gates -------------------------------------------------------------
TONE_GATE, EMOTION_GATE, PROBE_GATE, STABLE_ARI, LEAST_SUBCLUSTER, LEAST_RATINGS = 0.7, 0.5, 0.90, 0.6, 30, 20
