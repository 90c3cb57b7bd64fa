SECRET_NAME = "x"
