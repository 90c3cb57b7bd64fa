X = 1
