import importlib


def go(obj, name, table):
    getattr(obj, name)()
    table[name]()
    eval(name)
    importlib.import_module(name)
