"""Wording of the advice columns, kept apart from the rules that pick it."""

SCREEN_TEXT = {
    "blank": "Sin texto en pantalla; cuentan solo audio, imagen y ritmo.",
    "musical": "Texto leído como letra, título o crédito musical.",
    "humor": "Texto leído como parte del chiste o de su contexto.",
    "comercial": "Texto leído como refuerzo de oferta, prueba o acción.",
    "educativo": "Texto leído como ayuda para seguir la explicación.",
    "other": "Texto leído por su relación con el tema del video.",
}
SCREEN_MEANING = {
    "h": "Acompaña la situación cómica.",
    "c": "Acompaña una intención de venta.",
    "e": "Acompaña una explicación.",
}
SCREEN_MEANING_OTHER = "Aporta contexto general."

OCR_LOW_CONFIDENCE = "Lectura poco confiable; revisar a mano."
OCR_UNREADABLE = "Parece haber texto, pero no se pudo leer."
OCR_NONE = "No hay texto legible."

POLICY_NO_TEXT = "Nada que evaluar: no hay título, descripción ni transcripción."
POLICY_CLEAN = "Sin términos sensibles en el texto completo."
POLICY_CLEAN_PARTIAL = "Sin términos sensibles en título y descripción; falta la transcripción."
POLICY_FOUND = "Categorías detectadas: "
POLICY_TAIL = {
    "revisión humana": " Varias son graves: decide una persona.",
    "alto": " Riesgo alto: es probable que se limite la publicidad.",
    "medio": " Riesgo medio: el inventario puede reducirse.",
}
POLICY_NOT_EVALUATED = "Política no evaluada por falta de transcripción; decide una persona."

NO_COMMENTS = "No hay comentarios que analizar."

ADJUST_CTA = "Añadir una llamada a la acción al comienzo."
ADJUST_SCREEN_TEXT = "Acortar el texto en pantalla para una pieza tan breve."
ADJUST_BENEFIT = "Decir qué gana la persona que mira."
ADJUST_LENGTH = "Preparar un corte más breve para la pauta."
ADJUST_TRANSCRIPT = "Aportar transcripción o texto en pantalla legible."

PAID_NOT_YET = "No pautar por ahora: no se alcanza el umbral principal; el CPM es solo referencia."
PAID_VIABLE = "Viable: puntaje bueno y costo contenido; empezar con poco y escalar con datos reales."
PAID_MODERATE = "Moderado: prueba A/B con presupuesto corto y ajuste de segmentación."
PAID_CREATIVE = "La pieza promete, la eficiencia no: afinar audiencia antes de invertir más."
PAID_RISK = "Eficiencia dudosa: corregir mensaje, pieza o audiencia antes de pautar."

FACTOR_TEXT_GOOD = "Texto persuasivo."
FACTOR_TEXT_WEAK = "Texto poco persuasivo."
FACTOR_ENGAGEMENT_GOOD = "Interacción favorable para sus vistas."
FACTOR_ENGAGEMENT_LOW = "Interacción baja para sus vistas."
FACTOR_DURATION_GOOD = "Duración apta para anuncio."
FACTOR_DURATION_LONG = "Duración poco apta para una primera pauta."
FACTOR_SCREEN_TEXT = "Hay texto legible en pantalla."
FACTOR_SATURATION = "Demasiado texto en pantalla."
FACTOR_TRANSCRIPT = "Se contó con transcripción."

HEADLINE = {
    "IMPULSAR": "Listo para pauta.",
    "AJUSTAR ANTES DE IMPULSAR": "Casi listo: faltan ajustes.",
    "NO IMPULSAR": "No conviene pautar.",
    "REVISIÓN HUMANA": "Debe revisarlo una persona.",
}
HEADLINE_OTHER = "Seguir observando antes de decidir."
LEVEL_NAME = {"muy_alto": "muy alto", "alto": "alto", "medio": "medio", "bajo": "bajo"}
POLICY_STATUS = {
    "bajo": "Sin alertas", "medio": "Frases por cuidar", "alto": "Riesgo alto",
    "revisión humana": "Varios temas sensibles",
}
NOTHING_TO_DO = "Sin ajustes pendientes; mantener la pieza."

DECISION = {
    "review": "NO INVERTIR TODAVÍA: requiere revisión o ajustes de política.",
    "no": "NO INVERTIR: faltan señales para pauta.",
    "yes": "SÍ INVERTIR: supera el umbral de aptitud.",
    "adjust": "AJUSTAR ANTES DE INVERTIR: corregir y volver a evaluar.",
}

SCRIPT_MISSING = "No evaluable sin transcripción"
SCRIPT = {
    "has_transcript": "El guion se evaluó sobre la transcripción completa.",
    "hook_ok": "La apertura engancha.",
    "hook_weak": "La apertura puede ser más clara.",
    "hook_humor": "Abrir con una situación reconocible antes del remate.",
    "hook_commercial": "Abrir con el beneficio o el problema que se resuelve.",
    "hook_other": "Abrir con una pregunta o promesa concreta.",
    "humor_ok": "La intención de humor se entiende.",
    "humor_weak": "La intención de humor no se entiende del todo.",
    "humor_fix": "Preparar mejor el chiste para quien no conoce el contexto.",
    "humor_noise": "Quitar ruido verbal entre planteo y remate.",
    "value_ok": "La propuesta de valor está presente.",
    "value_weak": "La propuesta de valor no es explícita.",
    "value_fix": "Decir qué se gana y por qué actuar.",
    "cta_weak": "Falta una llamada a la acción comercial clara.",
    "cta_fix": "Cerrar con una acción acorde al objetivo.",
    "edu_ok": "La pieza busca enseñar: pesan claridad y orden.",
    "edu_fix": "Ordenar en pasos y adelantar la idea principal.",
    "clear_ok": "El mensaje es razonablemente claro.",
    "clear_weak": "El mensaje es ambiguo.",
    "clear_fix": "Elegir una idea central y repetirla.",
    "claims_weak": "Hay afirmaciones absolutas.",
    "claims_fix": "Cambiar promesas absolutas por afirmaciones verificables.",
    "try_humor": "Probar un remate más temprano.",
    "try_commercial": "Probar A/B con beneficio y acción más visibles.",
    "try_other": "Probar un comienzo más directo.",
    "no_weakness": "Sin debilidades críticas.",
}
SCRIPT_SUMMARY = {
    "humor": "Situación de humor o entretenimiento. Comienzo: ",
    "comercial": "Comunicación comercial. Comienzo: ",
    "educativo": "Explicación de un tema. Comienzo: ",
    "other": "Relato o información. Comienzo: ",
}
SCRIPT_READING = {
    "humor_good": "Humor entendible; cuidar ritmo y remate.",
    "humor_weak": "Humor por aclarar: falta contexto o remate.",
    "commercial_good": "Intención comercial clara; reforzar prueba y cierre.",
    "commercial_weak": "Intención comercial presente, promesa o cierre débiles.",
    "educational": "Depende de que se entienda pronto qué se aprenderá.",
    "ambiguous": "Mensaje ambiguo; ordenar la idea central.",
    "other": "Lectura inicial posible; alinear con el objetivo.",
}
SUGGEST_HOOK = {
    "humor": "Contexto mínimo del chiste y una tensión que anuncie el remate.",
    "educativo": "Decir en tres segundos qué se aprenderá sobre ",
    "comercial_title": "Mostrar antes que nada el problema o beneficio de ",
    "comercial": "Promesa concreta sobre ",
    "title": "Convertir en pregunta el comienzo de ",
    "other": "Pregunta clara sobre ",
}
SUGGEST_CTA = {
    "soft": "Invitar con suavidad a comentar, compartir o seguir.",
    "educativo": "Invitar a guardar, preguntar o ver el recurso.",
    "comercial": "Pedir una acción concreta: comprar, agendar, visitar.",
    "other": "Pedir una acción acorde al objetivo.",
}
SUGGEST_COPY = {
    "humor": "Pieza de alcance con remate claro para ",
    "claims": "Propuesta verificable y sin promesas absolutas para ",
    "comercial": "Beneficio, prueba y acción sencilla para ",
    "other": "Comienzo claro y cierre memorable para ",
}

MESSAGE_WEAK = {
    "cta": "Llamada a la acción poco explícita.",
    "benefit": "Beneficio poco reforzado.",
    "saturation": "Texto en pantalla excesivo.",
    "long": "Duración larga para formatos pagos.",
    "policy": "Riesgo de política: ",
    "none": "Sin debilidades críticas.",
}
MESSAGE_STRONG = {
    "trust": "Señales de confianza.",
    "promo": "Elementos promocionales.",
    "benefit": "Propuesta de valor reconocible.",
    "cta": "Llamada a la acción presente.",
    "none": "Información suficiente para una primera lectura.",
}
MESSAGE_BASIS = "Redacción por reglas; no reemplaza al modelo."

RULE_NEXT_HUMOR = (
    "Comprobar que el remate se entienda solo.",
    "Dejar texto en pantalla solo si ayuda al ritmo.",
    "Probar un corte más breve si la retención cae pronto.",
)
RULE_NEXT_DEFAULT = (
    "Mostrar el beneficio en los primeros segundos.",
    "Simplificar lo visual y reforzar el mensaje.",
    "Probar una apertura más directa.",
)

VISUAL = {
    "thirds": ("Mover el sujeto a un cruce de tercios.", "Afinar el encuadre hacia un tercio.", "Tercios bien usados."),
    "golden": ("Acercar el foco a las líneas áureas.", "Afinar hacia un cruce áureo.", "Proporción áurea bien usada."),
    "balance": ("Redistribuir el peso visual.", "Equilibrio bien resuelto."),
    "focus": "Concentrar el interés en un solo elemento.",
    "few_edges": "Añadir un punto focal al comienzo.",
    "contrast": "Separar sujeto y fondo con más contraste.",
    "brightness": "Corregir la exposición.",
    "load": "Quitar elementos simultáneos.",
    "motion": "Sostener más los planos clave.",
    "no_text": "Añadir una frase breve en pantalla.",
}
VISUAL_SUMMARY = (
    ("en tercios", "fuera de tercios"),
    ("cerca de lo áureo", "lejos de lo áureo"),
    ("equilibrada", "desequilibrada"),
    ("foco claro", "foco difuso"),
    ("carga baja", "carga alta"),
)
VISUAL_VERDICT = ("Base visual sólida.", "Usable con ajustes.", "Corregir antes de invertir.")
VISUAL_AREAS = (
    "encuadre por tercios", "composición áurea", "balance geométrico", "claridad del foco", "carga visual",
)

CAMPAIGN = {
    "potenciar": ("Potenciar la campaña", "Subir el presupuesto por tramos", "Alcance y tasa de vista completa"),
    "reducir_duracion": ("Reducir la duración", "Editar una versión de menos de dos minutos", "Tasa de omisión"),
    "agregar_cta": ("Agregar llamada a la acción", "Cerrar con una acción concreta", "Clics por impresión"),
    "mejorar_confianza": ("Mejorar la confianza", "Mostrar respaldo o prueba", "Conversión"),
    "fortalecer_gancho": ("Fortalecer el gancho", "Abrir con urgencia o pregunta", "Retención inicial"),
    "monitorear": ("Seguir observando", "Reunir más datos antes de invertir", "Tendencia de vistas"),
}
