def ok(x):
    return (

class Half:
