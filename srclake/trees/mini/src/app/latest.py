LIMIT = 5
