# caf�
NAME = 1
