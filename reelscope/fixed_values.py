"""Values the results depend on, stated once.

Every list, table and constant below is a default argument somewhere in the
package; callers may pass their own.
"""

# ---------------------------------------------------------------------------
# Text-signal word lists
# ---------------------------------------------------------------------------
CTA_TERMS = (
    "compra", "comprar", "agenda", "agendar", "suscríbete", "suscribete", "clic", "click",
    "visita", "regístrate", "registrate", "descarga", "aprovecha", "llama", "contáctanos",
    "contactanos", "reserva", "prueba", "conoce", "entra", "mira", "descubre",
)
URGENCY_TERMS = (
    "hoy", "ahora", "últimos", "ultimos", "limitado", "solo", "oferta", "descuento",
    "promoción", "promocion", "gratis", "exclusivo", "imperdible", "ya",
)
TRUST_TERMS = (
    "oficial", "garantía", "garantia", "certificado", "seguro", "recomendado", "clientes",
    "testimonio", "verificado", "calidad", "expertos", "años", "experiencia",
)
BENEFIT_TERMS = (
    "beneficio", "mejora", "ahorra", "rápido", "rapido", "fácil", "facil", "resultado",
    "solución", "solucion", "crece", "gana", "aprende", "optimiza", "convierte",
)
PROMO_TERMS = ("oferta", "descuento", "gratis", "2x1", "promoción", "promocion", "cupón", "cupon")
PRICE_TERMS = ("$", "usd", "precio", "desde", "mensual", "pago", "dólar", "dolar")

# Light intent and on-screen-text relevance
RELEVANCE_STOPWORDS = (
    "de", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o",
    "en", "a", "por", "para", "con", "sin", "del", "al", "que", "como",
    "más", "mas", "muy", "este", "esta", "estos", "estas", "eso", "esa",
    "es", "son", "ser", "fue", "hay", "se", "su", "sus", "tu", "tus",
    "mi", "mis", "lo", "le", "les", "video", "youtube", "canal",
    "comentario", "comentarios", "contenido", "link", "http", "https",
    "www", "com", "reel", "short", "shorts", "post", "publicacion", "publicación",
)
LIGHT_HUMOR_TERMS = (
    "jaja", "jajaja", "jeje", "risa", "humor", "broma", "chiste", "meme",
    "parodia", "sketch", "comedia", "gracioso", "graciosa", "sarcasmo",
    "irónico", "ironico", "pov", "cuando", "fail", "fails", "absurdo", "random",
)
LIGHT_EDU_TERMS = (
    "tutorial", "aprende", "aprender", "guía", "guia", "paso a paso", "cómo",
    "como hacer", "explico", "explicar", "consejos", "tips", "clase", "curso",
)
LIGHT_COMMERCIAL_TERMS = (
    "compra", "comprar", "precio", "descuento", "oferta", "promoción", "promocion",
    "cupón", "cupon", "envío", "envio", "agenda", "reserva", "servicio",
    "producto", "tienda", "cliente", "clientes", "venta", "ventas", "gratis",
    "whatsapp", "cotiza", "cotizar", "link en bio",
)
LIGHT_MUSIC_TERMS = (
    "música", "musica", "canción", "cancion", "letra", "lyrics", "cover",
    "artista", "cantante", "banda", "álbum", "album", "single", "concierto",
    "verso", "coro", "beat", "remix", "videoclip",
)
LIGHT_NEWS_TERMS = ("noticia", "actualidad", "denuncia", "entrevista", "comunicado")

# Keyword groups of the on-screen-text fallback, in priority order
SCREEN_HUMOR_TERMS = ("jaja", "humor", "chiste", "meme", "comedia", "pov", "cuando ", "broma")
SCREEN_COMMERCIAL_TERMS = ("compra", "oferta", "descuento", "precio", "agenda", "reserva", "whatsapp", "cotiza")
SCREEN_EDU_TERMS = ("tutorial", "aprende", "paso", "tips", "consejo", "clase", "cómo", "como hacer")

# Script (transcript) word lists
SCRIPT_CTA_TERMS = (
    "subscribe", "like", "comment", "share", "click", "download", "visit", "buy", "try", "watch",
    "learn more", "sign up", "follow", "save", "join", "comenta", "suscríbete", "comparte", "guarda",
    "haz clic", "visita", "compra", "descarga", "regístrate", "sígueme", "conoce más",
)
SCRIPT_BENEFIT_TERMS = (
    "learn", "improve", "discover", "avoid", "reduce", "increase", "optimize", "how to", "why", "tips",
    "strategy", "mistake", "secret", "guide", "aprende", "mejora", "descubre", "evita",
    "aumenta", "optimiza", "cómo", "por qué", "consejos", "estrategia", "errores", "guía",
)
SCRIPT_URGENCY_TERMS = (
    "now", "today", "limited", "urgent", "last chance", "hoy", "ahora", "urgente", "última oportunidad", "limitado",
)
SCRIPT_TRUST_TERMS = (
    "official", "verified", "study", "evidence", "expert", "safe", "guarantee", "case study", "oficial",
    "verificado", "estudio", "evidencia", "experto", "seguro", "caso real",
)
SCRIPT_EXAGGERATED_TERMS = (
    "guaranteed", "100%", "without effort", "miracle", "instant", "get rich", "lose weight fast",
    "garantizado", "100 %", "sin esfuerzo", "milagroso", "resultado inmediato", "gana dinero rápido",
    "pierde peso rápido", "cura definitiva",
)
SCRIPT_GENERIC_OPENINGS = (
    "hello", "hi guys", "hey guys", "welcome", "today we are going", "in this video",
    "hola", "hola amigos", "bienvenidos", "en este video", "hoy vamos",
)
SCRIPT_QUESTION_STARTS = ("how", "why", "what", "when", "where", "cómo", "por qué", "qué")

# Intent-aware script analysis word lists
ANALYZER_HUMOR_TERMS = (
    "jaja", "jajaja", "jeje", "risa", "humor", "broma", "bromas",
    "chiste", "chistes", "meme", "memes", "parodia", "sketch", "comedia",
    "cómico", "comico", "gracioso", "graciosa", "sarcasmo", "irónico", "ironico",
    "troll", "fails", "fail", "absurdo", "absurda", "random", "reacción", "reaccion",
)
ANALYZER_EDU_TERMS = (
    "tutorial", "aprende", "aprender", "guía", "guia", "paso a paso", "cómo",
    "como hacer", "explico", "explicar", "consejos", "tips", "clase", "curso",
    "lección", "leccion", "método", "metodo", "herramienta", "tutoriales",
)
ANALYZER_COMMERCIAL_TERMS = (
    "compra", "comprar", "precio", "descuento", "oferta", "promoción", "promocion",
    "cupón", "cupon", "envío", "envio", "agenda", "reserva", "inscríbete", "inscribete",
    "servicio", "producto", "tienda", "catálogo", "catalogo", "cliente", "clientes",
    "venta", "ventas", "pago", "gratis", "whatsapp", "link en bio", "cotiza", "cotizar",
)
ANALYZER_NEWS_TERMS = (
    "noticia", "última hora", "ultima hora", "comunicado", "denuncia", "informe",
    "actualidad", "política", "politica", "gobierno", "elecciones", "declaró", "declaro",
)
ANALYZER_LIFESTYLE_TERMS = ("vlog", "historia", "experiencia", "reacción", "reaccion", "reto", "challenge")
ANALYZER_IRONY_TERMS = ("sarcasmo", "irónico", "ironico", "parodia")
ANALYZER_TESTIMONIAL_TERMS = ("testimonio", "case study", "caso real", "experiencia", "review")
ANALYZER_HOOK_STARTS = ("cómo", "como", "por qué", "porque", "qué", "que", "sabías", "sabias")
ANALYZER_SITUATION_TERMS = ("no vas a creer", "mira", "cuando", "pov", "imagina", "nadie")
ANALYZER_HOOK_HUMOR_CUES = ("cuando", "pov", "nadie", "mira", "imagina")
ANALYZER_HUMOR_FIT_CUES = ("cuando", "pov", "remate", "plot twist", "jaj", "meme", "broma")
ANALYZER_EDU_FIT_CUES = ("paso", "ejemplo", "primero", "segundo", "explico")

# Comment sentiment word lists
SENTIMENT_POSITIVE_TERMS = (
    "excelente", "genial", "increíble", "increible", "gracias", "perfecto", "buenísimo",
    "buenisimo", "fenomenal", "me encanta", "me encantó", "me encanto", "fascinante",
    "útil", "util", "aprendo", "aprendí", "aprendi", "recomiendo", "lo mejor", "top",
    "great", "amazing", "excellent", "love", "helpful", "thanks", "awesome",
    "fantastic", "brilliant", "perfect", "wonderful", "like", "best",
    "bravo", "super", "espectacular", "clarísimo", "clarisimo", "claro", "entendí",
    "entendi", "buen contenido", "sigue así", "sigue asi", "suscrito", "me suscribí",
    "me suscribi", "vale la pena", "funciona", "me sirvió", "me sirvio", "aporta",
)
SENTIMENT_NEGATIVE_TERMS = (
    "malo", "pésimo", "pesimo", "horrible", "terrible", "no sirve", "no funciona",
    "no entiendo", "confuso", "aburrido", "click bait", "clickbait", "mentira",
    "estafa", "engaño", "engano", "basura", "desperdicio", "pérdida de tiempo",
    "perdida de tiempo", "bad", "useless", "boring", "wrong",
    "misleading", "fake", "scam", "waste", "dislike", "nope", "awful", "poor",
    "no me gustó", "no me gusto", "decepcionante", "decepciona", "deficiente",
    "caro", "lento", "falló", "fallo", "problema", "fraude", "molesto", "queja",
)
SENTIMENT_INTENSIFIERS = (
    "muy", "super", "demasiado", "extremadamente", "completamente",
    "totalmente", "absolutamente", "increíblemente", "increiblemente", "realmente",
    "bastante", "quite", "very", "so", "extremely", "absolutely",
)
SENTIMENT_NEGATORS = ("no", "ni", "nunca", "jamás", "jamas", "tampoco", "sin", "not", "never", "barely")
SENTIMENT_STOPWORDS = (
    "de", "la", "el", "y", "en", "a", "que", "del", "los", "las", "un", "una",
    "por", "para", "con", "su", "al", "se", "es", "son", "como", "más", "mas",
    "pero", "sin", "ya", "muy", "sobre", "entre", "hay", "ser", "fue", "han",
    "ha", "lo", "le", "les", "me", "te", "nos", "mi", "tu", "sus", "ese",
    "esa", "eso", "esto", "esta", "estos", "estas", "desde", "hasta", "donde",
    "cuando", "también", "tambien", "porque", "https", "http", "com", "www",
    "rt", "tco", "amp", "video", "imagen", "marca", "contenido", "publicación",
    "publicacion", "post", "reel", "comentario", "comentarios", "youtube", "canal",
    "ver", "veo", "hacer", "hace", "haces", "solo", "asi", "así", "ahi", "ahí",
    "este", "uno", "dos", "tres", "parte", "tema",
)

# ---------------------------------------------------------------------------
# Advertising-policy screening
# ---------------------------------------------------------------------------
POLICY_TERMS = {
    "clickbait": (
        "no creerás", "no vas a creer", "increíble", "shocking", "te volará",
        "100% verdadero", "esto cambia todo", "te hará llorar", "antes de que lo borren",
        "secreto revelado", "no quieren que sepas", "click aquí",
    ),
    "afirmaciones_exageradas": (
        "garantizado 100", "garantizado al 100", "resultados garantizados",
        "sin fallar", "infalible", "milagroso", "milagrosa", "milagro",
        "el mejor del mundo", "el único método", "siempre funciona",
        "nunca falla", "100% efectivo", "100% seguro",
    ),
    "lenguaje_inapropiado": (
        "mierda", "puta", "puto", "joder", "carajo", "pendejo", "pendeja",
        "cabrón", "cabrona", "verga", "coño", "imbécil", "estúpido", "idiota",
        "fuck", "shit", "bitch", "asshole",
    ),
    "violencia": (
        "matar", "asesinar", "asesinato", "homicidio", "torturar", "tortura",
        "disparar", "balear", "ejecutar a", "golpear hasta", "sangrando",
        "decapitar", "apuñalar", "secuestro", "secuestrar",
    ),
    "contenido_adulto": (
        "porno", "pornografía", "porn", "xxx", "sexo explícito", "desnudo total",
        "nudes", "onlyfans", "cam show", "contenido para adultos", "+18 explícito",
        "escena sexual",
    ),
    "drogas": (
        "cocaína", "cocaina", "marihuana", "weed", "heroína", "heroina",
        "metanfetamina", "crystal meth", "lsd", "éxtasis", "extasis", "mdma",
        "drogarse", "drogas duras", "consumir droga",
    ),
    "armas": (
        "arma de fuego", "pistola ilegal", "rifle de asalto", "ak-47", "ak47",
        "granada", "explosivo casero", "bomba casera", "munición ilegal",
        "cómo fabricar arma", "como fabricar arma",
    ),
    "apuestas": (
        "apostar online", "apuestas online", "casino online", "ruleta gratis",
        "tragamonedas", "slots gratis", "betting", "bono de casino", "ganar apostando",
        "1xbet", "stake casino",
    ),
    "salud_o_perdida_de_peso": (
        "pierde peso rápido", "pierde peso en una semana", "baja 10 kilos",
        "baja 20 kilos", "dieta milagrosa", "quema grasa garantizado",
        "cura el cáncer", "cura cancer", "remedio milagroso",
        "tratamiento garantizado", "elimina diabetes",
    ),
    "claims_financieros": (
        "hazte rico", "haz dinero fácil", "gana dinero fácil", "ingresos pasivos garantizados",
        "trabaja desde casa y gana miles", "duplica tu dinero", "inversión 100% segura",
        "rentabilidad garantizada", "sin riesgo financiero",
        "criptomoneda 100x", "shitcoin x100",
    ),
    "odio_lenguaje_ofensivo": (
        "odio a los", "muerte a los", "hay que eliminar a",
        "raza inferior", "subhumano", "supremacía",
    ),
    "desinformacion": (
        "la tierra es plana", "vacunas causan autismo",
        "5g causa", "covid es mentira", "no existe el cambio climático",
        "no existe el covid", "los medicamentos no funcionan",
    ),
}
POLICY_LABELS = {
    "clickbait": "clickbait",
    "afirmaciones_exageradas": "afirmaciones exageradas",
    "lenguaje_inapropiado": "lenguaje inapropiado",
    "violencia": "violencia",
    "contenido_adulto": "contenido adulto",
    "drogas": "drogas",
    "armas": "armas",
    "apuestas": "apuestas",
    "salud_o_perdida_de_peso": "salud o pérdida de peso",
    "claims_financieros": "claims financieros",
    "odio_lenguaje_ofensivo": "odio/lenguaje ofensivo",
    "desinformacion": "desinformación",
}
POLICY_SEVERITY = {
    "clickbait": "medio",
    "afirmaciones_exageradas": "medio",
    "lenguaje_inapropiado": "medio",
    "violencia": "alto",
    "contenido_adulto": "alto",
    "drogas": "alto",
    "armas": "alto",
    "apuestas": "alto",
    "salud_o_perdida_de_peso": "alto",
    "claims_financieros": "alto",
    "odio_lenguaje_ofensivo": "alto",
    "desinformacion": "alto",
}

# ---------------------------------------------------------------------------
# Paid campaigns
# ---------------------------------------------------------------------------
NICHE_TERMS = {
    "educación": ("curso", "tutorial", "aprende", "clase", "guía", "guia", "tips", "enseño", "capacitación", "webinar"),
    "retail/ecommerce": ("compra", "tienda", "producto", "envío", "envio", "descuento", "oferta", "precio", "promo", "shop"),
    "servicios": ("agenda", "reserva", "consulta", "servicio", "cotiza", "whatsapp", "asesoría", "asesoria", "cita"),
    "entretenimiento": ("meme", "humor", "comedia", "música", "musica", "cover", "show", "podcast", "viral", "trend"),
    "tecnología": ("app", "software", "ia", "inteligencia artificial", "automatiza", "digital", "tecnología", "tecnologia", "saas"),
    "salud/bienestar": ("salud", "bienestar", "fitness", "nutrición", "nutricion", "entrenamiento", "terapia"),
    "gastronomía": ("restaurante", "comida", "menú", "menu", "receta", "chef", "sabor", "delivery"),
    "inmobiliario": ("casa", "departamento", "inmueble", "terreno", "alquiler", "venta", "propiedad"),
}
NICHE_DEFAULT = "general/branding"
NICHE_BASE_CPM = {
    "entretenimiento": 3.80,
    "gastronomía": 4.60,
    "educación": 5.40,
    "retail/ecommerce": 6.20,
    "salud/bienestar": 7.00,
    "servicios": 7.60,
    "tecnología": 8.80,
    "inmobiliario": 9.80,
    "general/branding": 5.60,
}
NICHE_ALIASES = {
    "educacion": "educación",
    "ecommerce": "retail/ecommerce",
    "retail": "retail/ecommerce",
    "tecnologia": "tecnología",
    "salud": "salud/bienestar",
    "bienestar": "salud/bienestar",
    "gastronomia": "gastronomía",
    "branding": "general/branding",
    "general": "general/branding",
}
NICHE_AUTO_VALUES = ("auto", "automático", "automatico", "otro", "otros", "other")
GATE_THRESHOLD = 0.51
CPM_JITTER_SPAN = 0.115
CPM_FLOOR, CPM_CEILING = 2.20, 18.00

# ---------------------------------------------------------------------------
# Decision tables
# ---------------------------------------------------------------------------
DEFAULT_CPM = 5.0
LEVEL_MULTIPLIER = {"bajo": 0.70, "medio": 1.00, "alto": 1.30, "muy_alto": 1.60}
LEVEL_CUTS = (("muy_alto", 0.85), ("alto", 0.65), ("medio", 0.40))
SCORE_PENALTY = {"bajo": 1.00, "medio": 0.85, "alto": 0.50, "revisión humana": 0.30}
SCORE_PENALTY_DEFAULT = 0.85
PROJECTION_PENALTY = {"bajo": 1.0, "medio": 0.82, "alto": 0.45, "revisión humana": 0.25}
PROJECTION_PENALTY_DEFAULT = 0.75
RISK_BAR = {"bajo": 18, "medio": 50, "alto": 80, "revisión humana": 95}
RISK_BAR_DEFAULT = 50
PROBABILITY_FLOOR, PROBABILITY_CEILING = 0.02, 0.98
HYBRID_WEIGHTS = {
    "model_probability": 0.50, "engagement_rate": 0.18, "share_rate": 0.0,
    "retention_rate": 0.17, "views_per_hour": 0.15,
}
TEXT_POWER_WEIGHTS = {"cta": 0.20, "benefit": 0.18, "urgency": 0.15, "trust": 0.12, "promo": 0.10, "price": 0.08}
LABEL_WEIGHTS = {
    "views_per_day": 0.35, "engagement_rate": 0.25, "like_rate": 0.15,
    "comment_rate": 0.10, "text_power_score": 0.10, "duration_fit_score": 0.05,
}
DURATION_FIT_STEPS = ((7, 0.95), (15, 0.90), (30, 0.80), (60, 0.70), (180, 0.55))
DURATION_FIT_UNKNOWN, DURATION_FIT_REST = 0.50, 0.40

# Model feature set and corpus schema
TEXT_FEATURE = "text_total"
NUMERIC_FEATURES = (
    "title_len", "description_len", "text_total_word_count",
    "cta_flag", "urgency_flag", "trust_flag", "promo_flag", "benefit_flag", "price_flag",
    "duration_seconds",
)
CATEGORICAL_FEATURES = ("category_id",)
TARGET = "boost_candidate"
LEAKING_COLUMNS = (
    "views_per_day", "engagement_rate", "like_rate", "comment_rate", "text_power_score",
    "duration_fit_score", "views", "likes", "comments", "log_views", "log_likes", "log_comments",
    "organic_performance_score", "target_threshold",
)
COLUMN_ALIASES = (
    ("view_count", "views"),
    ("views_count", "views"),
    ("likes_count", "likes"),
    ("like_count", "likes"),
    ("comment_count", "comments"),
    ("comments_count", "comments"),
    ("publishedAt", "published_at"),
    ("publish_time", "published_at"),
    ("categoryId", "category_id"),
    ("channelTitle", "channel_title"),
    ("channel", "channel_title"),
)
PROFILE_COLUMNS = (
    "views", "likes", "comments", "engagement_rate", "like_rate", "comment_rate", "views_per_day",
    "duration_seconds", "title_len", "description_len", "text_total_word_count",
)
REAL_SOURCE_MARKERS = ("trending", "kaggle", "daily_", "datasnaek", "youtube_")
PAID_CATEGORICAL = ("source_dataset", "campaign", "channel", "device", "ad_type", "age", "gender", "city")
PAID_NUMERIC = ("campaign_numeric_id", "ad_numeric_id", "interest", "month", "weekday", "ctr_prior", "cvr_prior")
PAID_TARGETS = ("paid_performance_score", "cpm")

# Research-notebook word patterns (whole words)
NOTEBOOK_CTA_WORDS = (
    "agenda", "reserva", "llama", "contacta", "inscribete", "descarga", "visita", "solicita", "compra", "suscribete",
)
NOTEBOOK_TRUST_WORDS = (
    "garantia", "respaldo", "certificado", "oficial", "confianza", "verificado", "premiado", "profesional",
)
NOTEBOOK_VALUE_WORDS = (
    "gratis", "descuento", "oferta", "precio", "ahorra", "exclusivo", "nuevo", "mejor", "garantia", "garantía",
)
NOTEBOOK_PROMO_WORDS = (
    "solo hoy", "no te pierdas", "últimas", "ultimas", "último", "ultimo", "ya", "ahora mismo", "aprovecha",
)
NOTEBOOK_THRESHOLD = 0.40

# Checks on generated text
GENERATED_MIN_WORDS = 90
GENERATED_FORBIDDEN = (
    "entrada de 2030", "entorno de 2030", "clave de entrada", "rellenar las traducciones",
    "no utilice json", "se ha crecido una proteccion", "cuando haces una entrevista en 2030",
)
GENERATED_DOMAIN_TERMS = (
    "video", "contenido", "youtube", "retención", "transcripción", "ocr",
    "sentimiento", "pauta", "marketing", "guion", "visual", "recomendación",
    "humor", "métrica", "comentarios", "audiencia",
)
GUARD_BAD_MARKERS = (
    "veredicted", "hallazgan", "bimhame", "patrón del cliente",
    "prueba de hábito", "preferencia por el humor y el interesante",
)
CONTRACT_KEYS = (
    "claridad_mensaje", "fuerza_cta", "coherencia_semantica", "complejidad_sintactica", "tipo_contenido",
    "riesgo_comunicacional", "fortalezas", "debilidades", "ajustes_sugeridos", "recomendacion_llm", "justificacion",
)
