"""SQL snippets used inside pyspark.ml stages."""

# Accented Latin letters and their plain forms
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def strip_accents(column: str) -> str:
    return f"translate({column}, '{ACCENTED}', '{PLAIN}')"
