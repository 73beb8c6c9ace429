"""Pure Column -> Column functions: titles, places, URLs, HTML, skill tokens, numbers."""
