import pytest

from impactframe.sources.rust import RustSyntaxError, parse

TEXT = '''#!/usr/bin/env run
//! docs { with a brace
#![allow(dead_code)]
use std::{fmt, io};
extern crate alloc;
/* a /* nested */ comment } */
pub(crate) const LIMIT: [u8; 2] = [b'{', b'"'];
static mut S: &str = r#"quote " and } brace"#;
pub struct Point<'a> { x: &'a str }
struct Unit;
pub enum E { A { x: u8 }, B(u8) }
pub trait Shape { const N: usize; fn area(&self) -> f64 { 1.0 } }
impl<'a> Shape for Point<'a> where Point<'a>: Sized {
    const N: usize = 1;
    pub unsafe extern "C" fn area(&self) -> f64 { let c = '}'; 2.0..3.0; 0.0 }
}
macro_rules! make { ($x:expr) => { $x } }
make!{ 1 }
mod child;
#[path = "other/place.rs"]
mod placed;
#[cfg_attr(windows, path = "win.rs")]
mod maybe;
pub async fn run() { include_str!("../data/a.txt"); }
#[cfg(test)]
mod tests {
    use super::*;
    #[tokio::test]
    async fn works() {}
    mod deep { fn helper() {} }
}
'''


def test_items():
    p = parse(TEXT, "core/src/lib.rs")
    got = {(i["kind"], i["name"]): i for i in p.items}
    for key in [("Const", "LIMIT"), ("Static", "S"), ("Struct", "Point"), ("Struct", "Unit"), ("Enum", "E"), ("Trait", "Shape"),
                ("AssocItem", "Shape::area"), ("Macro", "make"), ("Mod", "child"), ("Fn", "run"), ("Mod", "tests"),
                ("Mod", "tests::deep"), ("Fn", "tests::deep::helper"), ("Impl", "impl@13:0"), ("Use", "use@4:0")]:
        assert key in got, key
    assert not any("alloc" in n for _, n in got)
    assert got["Const", "LIMIT"]["visibility"] == "pub(crate)"
    assert got["Mod", "tests"]["is_test"] and got["Fn", "tests::deep::helper"]["is_test"] and not got["Fn", "run"]["is_test"]
    assert got["Mod", "tests"]["span"][0] == 25 and got["Mod", "tests"]["span"][2] == 31


def test_modules_and_includes():
    p = parse(TEXT, "core/src/lib.rs")
    targets = {m["item"]["name"]: m["targets"] for m in p.modules}
    assert targets["child"] == ["core/src/child.rs", "core/src/child/mod.rs"]
    assert targets["placed"] == ["core/src/other/place.rs"]
    assert targets["maybe"] == ["core/src/win.rs", "core/src/maybe.rs", "core/src/maybe/mod.rs"]
    assert ("core/data/a.txt", "include_str") in p.sources and ("core/src/other/place.rs", "path_module") in p.sources
    assert parse("mod x;", "core/src/a.rs").modules[0]["targets"] == ["core/src/a/x.rs", "core/src/a/x/mod.rs"]


@pytest.mark.parametrize("text", ["fn f() {", "fn f() { ) }", 'static S: &str = "open;', "what is this", "/* open"])
def test_errors(text):
    with pytest.raises(RustSyntaxError):
        parse(text, "a.rs")
