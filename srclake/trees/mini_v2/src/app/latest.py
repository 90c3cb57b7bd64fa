LIMIT = 6
